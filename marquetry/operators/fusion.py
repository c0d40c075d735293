"""Comparison of partial descriptions, and consolidation of one query's candidates.

Consolidation is an ordered fold: candidates come by falling confidence, one that contradicts what was
accepted before is dropped, any other fills the fields that are still empty. The few candidates that a query usually has are folded in one aggregate. A query
of more than FOLD_ROWS is not gathered: a field is filled once, so the running result changes no more
often than it has fields, and the fold is a few rounds over all such queries together: in each, every undecided candidate is held against its query's running result, the
first that adds something moves the result on, and all up to it are decided. A round is a join and a
pre-aggregated minimum; no query's candidates are gathered anywhere, however many there are.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from marquetry.functions.text import folded_title, fuzzy_ratio, ratio
from marquetry.operators.skew import hot_split_join
from marquetry.session import Scratch

# Seconds by which runtimes of a medium may differ, and of any other or without a medium.
RUNTIME_TOLERANCE = {"movie": 120.0, "series": 30.0, "tv": 0.0, "music": 3.0, "music_video": 30.0, "podcast": 30.0, "book": 0.0}
DEFAULT_TOLERANCE = 5.0
# Years that may lie between two descriptions, and the least ratio of two titles.
YEAR_WINDOW, TITLE_RATIO = 1, 0.92
#: Candidates of a query that are gathered at most; more go through rounds, with the same result.
FOLD_ROWS = 32
#: Fields that a result is made of, with their types; the first five and variant_kind are compared.
FIELDS = {"title": "string", "year": "int", "medium": "string", "season": "int", "episode": "int", "runtime": "double", "variant_kind": "string", "artist": "string", "language": "string", "country": "string"}


def tolerance(medium: str) -> str:
    """SQL of the runtime tolerance of a medium given as SQL."""
    return f"CASE {medium} " + " ".join(f"WHEN '{m}' THEN {t}D" for m, t in RUNTIME_TOLERANCE.items()) + f" ELSE {DEFAULT_TOLERANCE}D END"


def title_ratio(a: Column, b: Column) -> Column:
    """Ratio of two folded titles: 1 when equal, null when either is missing."""
    differ = a != b
    return F.when(a == b, 1.0).otherwise(fuzzy_ratio(F.when(differ, a), F.when(differ, b)))


def _conflicts_sql(a: str, b: str, ratio: str | None) -> str:
    """SQL of ``conflicts``, with the title ratio as SQL."""
    both = f"IF({a}.medium IS NOT NULL AND {b}.medium IS NOT NULL, {a}.medium, NULL)"
    rules = {"title": f"{ratio} < {TITLE_RATIO}D"} if ratio else {}
    rules |= {
        "year": f"abs({a}.year - {b}.year) > {YEAR_WINDOW}",
        "medium": f"{a}.medium <> {b}.medium",
        "season": f"{a}.season <> {b}.season",
        "episode": f"{a}.episode <> {b}.episode",
        "runtime": f"abs({a}.runtime - {b}.runtime) > {tolerance(both)}",
        "variant_kind": f"{a}.variant_kind <> {b}.variant_kind",
    }
    return f"array_compact(array({', '.join(f"IF({rule}, '{name}', NULL)" for name, rule in rules.items())}))"


def conflicts(a: str, b: str, ratio: str | None) -> Column:
    """Names of the fields in which structs ``a`` and ``b`` contradict each other; none for absent fields.

    ``ratio`` is a column with the title ratio, null without titles; leave it out to compare no titles.
    """
    return F.expr(_conflicts_sql(a, b, ratio))


def match_quality(a: str, b: str, ratio: Column) -> Column:
    """0..1: the title ratio, halved for years too far apart and for another medium; 1 without anything to compare."""
    year = F.expr(f"IF(coalesce(abs({a}.year - {b}.year) > {YEAR_WINDOW}, false), 0.5D, 1.0D)")
    medium = F.expr(f"IF(coalesce({a}.medium <> {b}.medium, false), 0.5D, 1.0D)")
    return F.coalesce(ratio, F.lit(1.0)) * year * medium


def described(df: DataFrame, *extra: str) -> DataFrame:
    """``extra`` and a struct ``s`` of FIELDS (absent ones null) with the folded title as ``form``."""
    fields = [(F.col(f) if f in df.columns else F.lit(None)).cast(kind).alias(f) for f, kind in FIELDS.items()]
    title = F.col("title") if "title" in df.columns else F.lit(None).cast("string")
    return df.select(*extra, F.struct(*fields, folded_title(title).alias("form")).alias("s"))


def consolidate(candidates: DataFrame, local: DataFrame | None = None, titles: bool = True) -> tuple[DataFrame, DataFrame]:
    """(verdicts, results) of ``candidates`` (query_id, match_id, provider, confidence, seq and FIELDS).

    ``verdicts``: query_id, match_id, provider, confidence, place (orders a query's candidates), accepted,
    against ("local", the anchor's provider, or "consolidated" before there is one; null when accepted)
    and fields (those in conflict). ``results``: query_id, anchor (provider of the first accepted one),
    n_accepted, n_dropped, confidence (the best accepted), conflicted and FIELDS. After a conflict with
    the running result FIELDS are null; a conflict with ``local`` alone does no harm.

    Candidates come by (confidence falling, seq, match_id), nulls last; repeated rows count once. ``local``
    (query_id and FIELDS, one row a query) is what the caller knows: it comes first and is never given up.
    Any column may be missing or null. No candidates give no rows.
    """
    scratch = Scratch(candidates.sparkSession)
    place = F.struct((-F.coalesce(F.nanvl("confidence", F.lit(-1.0)), F.lit(-1.0))).alias("c"), F.coalesce("seq", F.lit(1 << 30)).cast("int").alias("q"), F.col("match_id").cast("bigint").alias("m"))
    rows = described(candidates.withColumn("place", place), "query_id", "match_id", "provider", "confidence", "place").dropDuplicates(["query_id", "match_id", "provider", "confidence"])
    rows = scratch.keep(rows)
    state = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    if local is not None:
        state = state.join(described(local, "query_id"), "query_id", "left")
    else:
        state = state.withColumn("s", F.lit(None).cast(rows.schema["s"].dataType))
    state = state.select("query_id", "n", "s", F.col("s").alias("own"), F.lit(None).cast("string").alias("anchor"), F.lit(None).cast(rows.schema["place"].dataType).alias("at"))
    state, seen = scratch.measured(state, total=F.sum("n"), largest=F.max("n"))
    few = state.where(F.col("n") <= FOLD_ROWS)
    decided = [_folded(rows.join(few.select("query_id", "own"), "query_id"), titles)]
    ends = [decided[0].select("query_id", "anchor_at_last", "end")]
    decided = [decided[0].select("query_id", F.inline("v"))]
    if (seen["largest"] or 0) > FOLD_ROWS:
        parts, state = _rounds(rows, state.where(F.col("n") > FOLD_ROWS), seen, titles, scratch)
        decided += parts
        ends.append(state.select("query_id", F.col("anchor").alias("anchor_at_last"), F.col("s").alias("end")))
    state = functools.reduce(DataFrame.unionByName, ends).select("query_id", F.col("anchor_at_last").alias("anchor"), F.col("end").alias("s"))
    verdicts = functools.reduce(DataFrame.unionByName, decided)
    against = F.when(F.size("vs_local") > 0, "local").when(F.size("vs_run") > 0, F.coalesce("anchor", F.lit("consolidated")))
    fields = F.when(F.size("vs_local") > 0, F.col("vs_local")).when(F.size("vs_run") > 0, F.col("vs_run"))
    verdicts = scratch.keep(verdicts.select("query_id", "match_id", "provider", "confidence", "place", against.isNull().alias("accepted"), against.alias("against"), fields.alias("fields")))
    counts = verdicts.groupBy("query_id").agg(F.count_if("accepted").alias("n_accepted"), F.count_if(~F.col("accepted")).alias("n_dropped"), F.max(F.when(F.col("accepted"), F.nanvl("confidence", F.lit(None)))).alias("confidence"), F.coalesce(F.bool_or(F.col("against") != "local"), F.lit(False)).alias("conflicted"))
    results = counts.join(state, "query_id").select("query_id", "anchor", "n_accepted", "n_dropped", "confidence", "conflicted", *[F.when(~F.col("conflicted"), F.col(f"s.{f}")).alias(f) for f in FIELDS])
    return verdicts, results


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def _ratios(forms: pd.Series) -> pd.Series:
    """Title ratios of every two of a query's titles: row j, place i below it, for j < i."""
    seen: dict[tuple[str, str], float] = {}

    def of(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        if (a, b) not in seen:
            seen[a, b] = 1.0 if a == b else ratio(a, b)
        return seen[a, b]

    return pd.Series([[[of(a, b) if j < i else None for i, b in enumerate(f)] for j, a in enumerate(f)] for f in forms])


def _folded(rows: DataFrame, titles: bool) -> DataFrame:
    """(query_id, v, anchor_at_last, end): the fold of queries with FOLD_ROWS candidates at most, as one aggregate.

    ``v`` are the verdicts, ``end`` the running result after the last candidate.
    """
    lists = rows.groupBy("query_id").agg(F.first("own").alias("own"), F.array_sort(F.collect_list(F.struct("place", "match_id", "provider", "confidence", F.col("s").alias("c")))).alias("cs"))
    if titles:
        lists = lists.withColumn("m", _ratios(F.concat(F.array("own.form"), F.transform("cs", lambda x: x["c"]["form"]))))
    at = lambda j: f"get(get(m, {j}), x.i)" if titles else None
    own = _conflicts_sql("own", "x.c", at("0"))
    numbered = lists.withColumn("cs", F.expr("transform(cs, (x, i) -> named_struct('i', i + 1, 'x', x))"))
    flat = "named_struct('i', y.i, 'place', y.x.place, 'match_id', CAST(y.x.match_id AS BIGINT), 'provider', y.x.provider, 'confidence', y.x.confidence, 'c', y.x.c)"
    judged = "named_struct('i', x.i, 'place', x.place, 'match_id', x.match_id, 'provider', x.provider, 'confidence', x.confidence, 'c', x.c, 'vs_local', "
    numbered = numbered.withColumn("cs", F.expr(f"transform(transform(cs, y -> {flat}), x -> {judged}{own}))"))
    struct = ", ".join(f"{f}:{kind}" for f, kind in (FIELDS | {"form": "string"}).items())
    verdict = "match_id:bigint,provider:string,confidence:double,place:struct<c:double,q:int,m:bigint>,vs_local:array<string>,vs_run:array<string>,anchor:string"
    start = f"named_struct('s', CAST(own AS struct<{struct}>), 'holder', IF(own.form IS NULL, -1, 0), 'anchor', CAST(NULL AS STRING), 'v', CAST(array() AS array<struct<{verdict}>>))"
    merged = "named_struct(" + ", ".join(f"'{f}', coalesce(acc.s.{f}, x.c.{f})" for f in (*FIELDS, "form")) + ")"
    ok = "(size(x.vs_local) = 0 AND size(r) = 0)"
    said = "named_struct('match_id', x.match_id, 'provider', x.provider, 'confidence', x.confidence, 'place', x.place, 'vs_local', x.vs_local, 'vs_run', r, 'anchor', acc.anchor)"
    empty = "named_struct(" + ", ".join(f"'{f}', CAST(acc.s.{f} AS {kind})" for f, kind in (FIELDS | {"form": "string"}).items()) + ")"
    step = f"named_struct('s', IF({ok}, {merged}, {empty}), 'holder', IF({ok} AND acc.holder < 0 AND x.c.form IS NOT NULL, x.i, acc.holder), 'anchor', IF({ok}, coalesce(acc.anchor, x.provider), acc.anchor), 'v', array_append(acc.v, {said}))"
    # the conflicts are bound to r, so that they are worked out once a candidate
    bound = f"get(transform(array({_conflicts_sql('acc.s', 'x.c', at('acc.holder'))}), r -> {step}), 0)"
    done = numbered.withColumn("o", F.expr(f"aggregate(cs, {start}, (acc, x) -> {bound})"))
    return done.select("query_id", F.col("o.v").alias("v"), F.col("o.anchor").alias("anchor_at_last"), F.col("o.s").alias("end"))


def _rounds(rows: DataFrame, state: DataFrame, seen: dict, titles: bool, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The same fold for queries of any size, in a round for each change of the running result: (verdicts, states)."""
    ratio = lambda a, b: title_ratio(F.col(f"{a}.form"), F.col(f"{b}.form")) if titles else F.lit(None).cast("double")
    undecided = rows.join(state.select("query_id"), "query_id", "left_semi").withColumnRenamed("s", "c")
    decided = []
    for _ in range(len(FIELDS) + 2):
        met = hot_split_join(undecided, state, ["query_id"], "n", seen["total"] or 1, largest=seen["largest"] or 0)
        met = met.withColumn("ratio_own", ratio("own", "c")).withColumn("ratio_run", ratio("s", "c"))
        met = met.withColumn("vs_local", conflicts("own", "c", "ratio_own")).withColumn("vs_run", conflicts("s", "c", "ratio_run")).drop("ratio_own", "ratio_run")
        fills = F.expr(" OR ".join(f"(s.{f} IS NULL AND c.{f} IS NOT NULL)" for f in FIELDS)) | F.col("anchor").isNull()
        met = scratch.keep(met.withColumn("moves", (F.size("vs_local") == 0) & (F.size("vs_run") == 0) & fills))
        first = met.where("moves").groupBy("query_id").agg(F.min(F.struct("place", "provider", "c")).alias("first"))
        merged = F.struct(*[F.coalesce(f"s.{f}", f"first.c.{f}").alias(f) for f in (*FIELDS, "form")])
        ahead, moved = scratch.measured(first.join(state, "query_id").select("query_id", "n", merged.alias("s"), "own", F.coalesce("anchor", "first.provider").alias("anchor"), F.col("first.place").alias("at")), moved=F.count(F.lit(1)))
        judged = met.join(ahead.select("query_id", F.col("at").alias("upto")), "query_id", "left")
        over = F.col("upto").isNull() | (F.col("place") <= F.col("upto"))
        decided.append(judged.where(over).select("query_id", F.col("match_id").cast("bigint").alias("match_id"), "provider", "confidence", "place", "vs_local", "vs_run", "anchor"))
        undecided = judged.where(~over).select(*undecided.columns)
        state = scratch.keep(ahead.unionByName(state.join(ahead, "query_id", "left_anti")))
        if not moved["moved"]:
            break
    return decided, state


def merged_ids(verdicts: DataFrame, ids: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """(query_id, field, value): identifiers of the accepted matches, the first that has a field decides.

    ``ids`` is (match_id, field, value); ``mapped`` what mappings add to a match, which fills gaps of the
    same match only. Null values are none; ties go to the smaller value.
    """
    entries = ids.select("match_id", "field", "value", F.lit(0).alias("rank"))
    if mapped is not None:
        entries = entries.unionByName(mapped.select("match_id", "field", "value", F.lit(1).alias("rank")))
    found = verdicts.where("accepted").select("query_id", "match_id", "place").join(entries.where("value is not null"), "match_id")
    best = found.groupBy("query_id", "field").agg(F.min(F.struct("place", "rank", "value")).alias("b"))
    return best.select("query_id", "field", "b.value")
