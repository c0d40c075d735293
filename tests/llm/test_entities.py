"""Blocking, components, survivors, works and names on small fixtures."""

from __future__ import annotations

import datetime as dt
import random
from itertools import combinations

import numpy as np
import pytest

from marquetry.llm import blocking, components, names, spelling, survivor, works
from marquetry.llm.blocking import block_pairs
from marquetry.llm.queries import ORACLE, QUERIES
from marquetry.session import Scratch
from tests.oracle import DATA, compare

NOW = dt.datetime(2024, 1, 1)


@pytest.mark.skipif(not DATA.exists(), reason="test data not present")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_duckdb(spark, name):
    compare(spark, QUERIES[name], ORACLE[name])


def brute_components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(1000, 1060)] + [(5, i) for i in range(100, 160)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)] + [(1, 1), (None, 3), (4, None), (1001, 1000)]
    got = components.components(spark.createDataFrame([(*p, "x") for p in pairs], "a long, b long, node string"), "a", "b")
    assert {r.node: r.component for r in got.collect()} == brute_components(pairs)
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_id_links_skip_placeholders_and_foreign_fields(spark):
    rows = [("imdb", " TT1 ", 1), ("imdb", "tt1\t", 2), ("imdb", "tt1", 2), ("studio_id", "s", 3), ("studio_id", "s", 4), ("imdb", "N/A", 5), ("imdb", "n/a", 6), ("imdb", "", 7), ("imdb", None, 8), (None, "tt1", 9), ("tmdb", "tt1", 10), ("imdb", "tt1", None)]
    links = components.id_links(spark.createDataFrame([(*r, 0) for r in rows], "field string, value string, pk long, least int"))
    assert [tuple(r) for r in links.collect()] == [(2, 1)]


@pytest.mark.parametrize("size", [60, 400])
def test_blocks_lose_no_pair(spark, size):
    rows = [(i, 7, [1, 2]) for i in range(size)] + [(i, 8, [1]) for i in range(1400, 1403)] + [(1500, 9, None), (0, 8, [])]
    facts = spark.createDataFrame([(i, i, 0) for i in {r[0] for r in rows}], "id long, twin long, fact int")
    got = [tuple(r) for r in block_pairs(spark.createDataFrame(rows, "id long, key long, refs array<long>"), facts).collect()]
    assert len(got) == len(set(got)) and set(got) == set(combinations(range(size), 2)) | set(combinations((0, 1400, 1401, 1402), 2))
    assert block_pairs(spark.createDataFrame([], "id long, key long, refs array<long>"), facts).count() == 0


def test_large_blocks_give_all_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocking, "TILE_ROWS", 30)
    rows = [(i, k, [1, i % 2]) for i in range(300) for k in (7, 8)] + [(i, 8, [1]) for i in range(300, 310)]
    keys = spark.createDataFrame(rows, "id long, key long, refs array<long>")
    facts = spark.createDataFrame([(i, i // 200, str(i % 3)) for i in range(310)], "id long, twin long, fact string")
    got = [tuple(r) for r in block_pairs(keys, limit=20, facts=facts).collect()]
    assert len(got) == len(set(got)) and set(got) == set(combinations(range(310), 2))
    near = [tuple(r) for r in block_pairs(keys, limit=20, facts=facts, apart=lambda x, y: x != y).collect()]
    assert len(near) == len(set(near)) and set(near) == {(a, b) for a, b in combinations(range(310), 2) if a % 3 == b % 3}


MATCH = "match_id long, query_id long, provider string, confidence double, accepted boolean, signals struct<title:string,artist:string,year:int,season:int,runtime:double,medium:string,language:string,country:string>, fetched_at timestamp, source string"


def answer(match, query, provider, conf, accepted=True, day=0, **signals):
    base = dict.fromkeys(("title", "artist", "year", "season", "runtime", "medium", "language", "country"))
    return match, query, provider, conf, accepted, tuple((base | signals).values()), NOW + dt.timedelta(days=day), "clash"


def survivors(spark, rows):
    providers = spark.createDataFrame([("tmdb", 1), ("anilist", 2)], "provider string, seq int")
    won, _ = survivor.discover(survivor.match_claims(spark.createDataFrame(rows, MATCH), providers))
    return {(r.object, r.field): -r.ref for r in won.collect()}


def test_survivors(spark):
    rows = [
        answer(1, 1, " TMDB ", 0.9, title="old", year=1990), answer(2, 1, "tmdb", 0.2, day=1, title="new", year=9999), answer(3, 1, "anilist", 0.5, title="N/A", year=1991, runtime=float("nan"), language=" UND"),
        answer(3, 1, "anilist", 0.5, title="N/A", year=1991, runtime=float("nan"), language=" UND"), answer(4, 1, "other", None, country="FR", runtime=-1.0), answer(5, 1, "tmdb", 1.0, accepted=False, day=9, artist="dropped"),
        answer(6, 2, "tmdb", 1.0, title="alone"), answer(6, 2, "tmdb", 1.0, title="alone"),
        answer(7, 3, "anilist", 0.5, title="b"), answer(8, 3, "tmdb", 0.5, title="a"), answer(9, 3, "zzz", 0.5, title="c"),
    ]
    assert survivors(spark, rows) == {(1, "title"): 2, (1, "year"): 3, (1, "country"): 4, (3, "title"): 8}
    assert survivors(spark, []) == {}


def test_truth_discovery_trusts_the_reliable(spark):
    rng, rows = random.Random(3), []
    for q in range(200):
        for s, p in (("good", 0.95), ("fair", 0.8), ("bad1", 0.35), ("bad2", 0.35)):
            rows.append((q, "f", s, f"true{q}" if rng.random() < p else f"lie{q}{rng.randint(0, 3)}", 0, q))
    won, trust = survivor.discover(spark.createDataFrame(rows, "object long, field string, source string, value string, priority int, ref long"))
    assert sum(r.value == f"true{r.object}" for r in won.collect()) >= 185
    t = {r.source: r.reliability for r in trust.collect()}
    assert t["good"] > t["fair"] > max(t["bad1"], t["bad2"])


def test_spelling():
    assert spelling.repair("GonzÃ³nenvonron") == "Gonzónenvonron"
    assert spelling.plain("Пазенвозопо Гравелунд") == "pazenvozopo gravelund"
    assert spelling.plain(None) == "" and spelling.plain("É") == "e"
    rng = random.Random(1)

    def brute(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    for _ in range(200):
        a, b = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in "ab"]
        assert spelling.lcs(a, b) == brute(a, b)


ITEM = "item_id long, source string, kind string, title string, sort_title string, original_title string, year int, release_date string, runtime_min double, overview string, ext_ids map<string,string>, fetched_at timestamp, loaded_at timestamp, a string"


def test_titles():
    assert works.parse_title("Bridge of Kunvenda, The [Restored]") == works.parse_title("the bridge of kunvenda")
    assert works.parse_title("Der Bridge von Kunvenda II")[1] == works.parse_title("The Bridge of Kunvenda - Part Two")[1] == 2
    assert works.parse_title("X Kunvenda: The Return")[1] == -1
    assert works.parse_title(None) == ([], 0) and works.parse_title("The") == (["the"], 0)


def test_works_match_and_remakes_do_not(spark):
    rng = random.Random(7)
    syllables = [c + v for c in "bdgkmnprstvz" for v in "aeiou"]
    rows, truth = [], {}
    for w in range(150):
        word = "".join(rng.choice(syllables) for _ in range(5)).title()
        title, year, minutes = f"{rng.choice(('The Tower of', 'A River in', 'Silent'))} {word}", rng.randint(1950, 2020), float(rng.randint(40, 200))
        for s, source in enumerate(("tmdb", "wikidata", "skyhook")):
            i = 10 * w + s
            shown = {0: title, 1: title.upper(), 2: title[:-2] + title[-1] + title[-2]}[s]
            rows.append((i, source, "movie", shown, "", "", year + s % 2, None, minutes if s < 2 else None, None, {"imdb": f"tt{w:07d}"} if w % 3 else None, NOW, NOW, "x"))
            truth[i] = w
        rows.append((10 * w + 5, "tmdb", "movie", title, "", None, year + 25, None, minutes + 40, None, {}, NOW, NOW, "x"))
        rows.append((10 * w + 6, "wikidata", "movie", title + " II", "", None, year + 4, None, minutes + 9, None, None, NOW, NOW, "x"))
        rows.append((10 * w + 7, "wikidata", "book", title, "", None, year, None, None, None, None, NOW, NOW, "x"))
    rows += [(9000, "tmdb", None, None, None, None, None, None, None, None, None, NOW, NOW, "x"), (9001, "wikidata", "movie", "", "", "", None, None, float("nan"), None, None, NOW, NOW, "x"), rows[0]]
    got = works.matches(spark.createDataFrame(rows, ITEM)).where(f"probability >= {works.MATCH}")
    pairs = {(r.item_id_a, r.item_id_b) for r in got.collect()}
    want = {p for w in range(150) for p in combinations((10 * w, 10 * w + 1, 10 * w + 2), 2)}
    assert len(pairs & want) / len(want) > 0.97 and len(pairs - want) / len(pairs) < 0.03
    assert works.matches(spark.createDataFrame([], ITEM)).count() == 0


def hot_title(count, seed=5):
    """Works of one title, two rows each, that only year and runtime tell apart."""
    rng, rows = random.Random(seed), []
    for w, (year, minutes) in enumerate(rng.sample([(y, m) for y in range(1950, 2021) for m in range(40, 201)], count)):
        for s, source in enumerate(("tmdb", "wikidata")):
            rows.append((2 * w + s, source, "movie", "The Tower of Bodagunteki", None, None, year, None, float(minutes), None, None, NOW, NOW, "x"))
    return rows


def test_a_hot_title_keeps_its_true_pairs(spark):
    got = works.matches(spark.createDataFrame(hot_title(400), ITEM))
    pairs = {(r.item_id_a, r.item_id_b) for r in got.select("item_id_a", "item_id_b").collect()}
    assert {(2 * w, 2 * w + 1) for w in range(400)} <= pairs
    assert len(pairs) == 400 * 400  # every row of one source with every row of the other


def test_large_blocks_pair_rows_that_share_neither_year_nor_runtime(spark):
    # two spellings, one source with years only and one with runtimes only: nothing but the title is common
    rows = [(i, "tmdb", "movie", "Bodagunteki Ravosumine", None, None, 1950 + i % 3, None, None, None, None, NOW, NOW, "x") for i in range(60)]
    rows += [(100 + i, "wikidata", "movie", "Bodagunteki Ravosumnie", None, None, None, None, 80.0 + i % 3, None, None, NOW, NOW, "x") for i in range(60)]
    got = works.matches(spark.createDataFrame(rows, ITEM)).select("item_id_a", "item_id_b").collect()
    assert len(got) == 60 * 60 and {tuple(r) for r in got} == {(a, 100 + b) for a in range(60) for b in range(60)}


def test_blocks_without_refs_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(blocking, "TILE_ROWS", 30)
    keys = spark.createDataFrame([(i, k) for i in range(130) for k in (7, 8)] + [(i, 9) for i in range(128, 140)], "id long, key long")
    facts = spark.createDataFrame([(i, i // 50, 0) for i in range(140)], "id long, twin long, fact int")
    got = [tuple(r) for r in block_pairs(keys, facts).collect()]
    assert len(got) == len(set(got)) and set(got) == set(combinations(range(130), 2)) | set(combinations(range(128, 140), 2))


def test_logistic_recovers_a_rule():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(works.FEATURES)))
    y = (x[:, 0] > 0.5).astype(float)
    w = works.calibrated(x, y)
    assert (((x @ w[:-1] + w[-1]) > 0) == (y == 1)).mean() > 0.95
    assert len(works.calibrated(x[:0], y[:0])) == len(works.FEATURES) + 1


PERSON = "person_id long, name string, kind string, sort_name string, aliases array<string>, birth_date string, country string, source string, image_url string, updated_at timestamp, entity string"


def test_name_scores():
    score = lambda a, b: names.name_score(names.name_words(a), names.name_words(b))
    for a, b in (("Samuel Gopinbapunba", "Gopinbapunba, Smauel"), ("J. E. Kumizebiran", "Johannes Edward Kumiz-ebiran"), ("Joe Goronnonkunse", "Joseph Goronnonkunse"), ("Vin kunnanavo Robert", "Robert Vinkunnanavo"), ("The Nitanpinnebu Pics", "Nitanpinneboo Pictures Ltd."), ("Prof. Rikanken Ashmoor", "RIKANKEN ÀSHMOOR")):
        assert score(a, b)[0] >= names.SAME_WORD and score(a, b)[1], (a, b)
    for a, b in (("Andrew Goranvideken", "Benjamin Goranvideken"), ("Andrew Goranvideken", "Andrew Kunmupebesi"), ("A. B.", "Anna Bell"), ("", "X")):
        assert not (score(a, b)[0] >= names.SAME_WORD and score(a, b)[1]), (a, b)


def test_entities_link_through_thirds_and_split_namesakes(spark):
    def person(i, name, born=None, aliases=(), kind="person", sort=None, country=None):
        return i, name, kind, sort, list(aliases) if aliases is not None else None, born, country, "tmdb", "", NOW, "x"

    rows = [
        person(1, "Richard Gozunsirangu", "1936-10-11", country="PL"), person(2, "Gozunsirangu, Rick", "1936"), person(3, "Richard Gozúnsirãngu", "1971-12-19"), person(4, "R. Gozunsirangu", None, ["Richard Gozunsirangu"], country="PL"),
        person(5, "Katherine Gozunsirangu", "1936-10-11"), person(6, "Richard Gozunsirangu", "1936-10-11", kind="group"), person(7, None, None, None), person(8, "", "", [""]), person(9, "Гозунсирангу Ричард", "1936-10-11", ["Richard Gozunsirangu"]),
        person(10, "x" * 3000, None), person(11, "Kenvotari Studios", kind="company"), person(12, "The Kenvotari Stds. [NL]", kind="company"), person(1, "Richard Gozunsirangu", "1936-10-11", country="PL"),
    ]
    members = names.entities(spark.createDataFrame(rows, PERSON))
    assert {r.person_id: r.entity for r in members.collect()} == {1: 1, 2: 1, 4: 1, 9: 1, 11: 11, 12: 11}
    assert {tuple(r) for r in names.entity_pairs(members).collect()} == {*combinations((1, 2, 4, 9), 2), (11, 12)}
    assert names.entities(spark.createDataFrame([], PERSON)).count() == 0


def test_a_hot_name_keeps_all_its_rows(spark):
    rows = [(i, "Bonkanreva Gravelund", "person", None, None, "1950-01-01", None, "tmdb", "", NOW, "x") for i in range(150)]
    got = names.entities(spark.createDataFrame(rows, PERSON)).collect()
    assert len(got) == 150 and {r.entity for r in got} == {0}


def test_a_hot_name_pairs_each_row_with_its_best_partner(spark):
    rows = []
    for e in range(120):
        year, day = 1950 + e % 3, f"{1 + e // 28:02}-{1 + e % 28:02}"
        short = f"{year}" if e % 2 else None
        births = (f"{year}-{day}", short, short)  # the third row equals the second
        rows += [(3 * e + i, "Bonkanreva Gravelund", "person", None, [], b, f"C{e}", "tmdb", "", NOW, "x") for i, b in enumerate(births)]
    got = names.entities(spark.createDataFrame(rows, PERSON)).collect()
    assert {r.person_id: r.entity for r in got} == {3 * e + i: 3 * e for e in range(120) for i in range(3)}


def test_rows_that_stand_for_others_vote_for_all_of_them(spark):
    person = lambda i, born, country=None: (i, "Richard Gozunsirangu", "person", None, None, born, country, "tmdb", "", NOW, "x")
    rows = [person(1, "1936-10-11"), person(2, "1936-10-11"), person(3, "1936-10-11"), person(4, "1971-12-19"), person(5, None), person(6, "", "")]
    got = names.entities(spark.createDataFrame(rows, PERSON))
    assert {r.person_id: r.entity for r in got.collect()} == {1: 1, 2: 1, 3: 1, 5: 1, 6: 1}


def random_name(rng):
    syllables = [c + v for c in "bdgkmnprst" for v in "aeiou"]
    first, last = rng.choice(("alexander", "alex", "sandy", "joseph", "joe", "j", "tori", "bob", "robert")), "".join(rng.choice(syllables[:12]) for _ in range(rng.randint(1, 5)))
    for _ in range(rng.randint(0, 3)):
        k = rng.randrange(len(last) + 1)
        last = last[:k] + rng.choice(("", "b", "do", " ")) + last[k + 1 :]
    return tuple((f"{first} {last}" if rng.random() < 0.8 else f"{last} {first}").split())


def typed(rng, words):
    text = " ".join(words)
    for _ in range(rng.randint(0, 3)):
        k = rng.randrange(len(text))
        text = text[:k] + rng.choice(("", "b", "do", " ")) + text[k + rng.randint(0, 1) :]
    return tuple(text.split()) or words


def test_pairs_without_plausible_traits_score_nothing():
    rng = random.Random(6)
    texts = sorted({n for _ in range(120) for b in [random_name(rng)] for n in (b, typed(rng, b), (*typed(rng, b), "de", "la", rng.choice(("x", "é王"))))})
    pairs = list(combinations(texts, 2))
    traits = np.array([names.name_traits(list(t)) for t in texts], np.int64)
    rows = np.array(list(combinations(range(len(texts)), 2)))
    fine = names.plausible(traits[rows[:, 0]], traits[rows[:, 1]])
    good = np.array([names.name_score(a, b)[0] >= names.SAME_WORD for a, b in pairs])
    assert good.sum() > 300 and not (good & ~fine).any() and not fine.all()
    one, other = [np.array([names.name_traits(list(names.name_words(t)))], np.int64) for t in ("Michael Gozunsirangu", "Stephanie Gozunsirangu")]
    assert not names.plausible(one, other)[0] and names.plausible(one, one)[0]


def test_name_candidates_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(names, "COMMON_WORD", 6)
    monkeypatch.setattr(blocking, "TILE_ROWS", 10)
    rng = random.Random(4)
    base = [random_name(rng) for _ in range(250)]
    texts = sorted({n for b in base for n in (b, typed(rng, b), typed(rng, b))})
    frame = spark.createDataFrame([(i, "person", list(n), 0) for i, n in enumerate(texts)], "nid long, kind string, words array<string>, a int")
    pairs, _ = names.name_pairs(frame, Scratch(spark))
    got = {tuple(r) for r in pairs.collect()}
    good = {(i, j) for i, j in combinations(range(len(texts)), 2) if (s := names.name_score(texts[i], texts[j]))[0] >= names.SAME_WORD and s[1]}
    assert len(good) > 300 and len(good & got) / len(good) >= 0.93
    assert all(a < b for a, b in got) and len(got) < len(texts) ** 2 / 8


def test_word_pairs_against_all_pairs(spark):
    rng = random.Random(8)
    words = sorted({w for _ in range(400) for n in [random_name(rng)] for w in (*n, *typed(rng, n))})
    got = {tuple(r) for r in names.similar_words(spark.createDataFrame([(w,) for w in words], "w string"), Scratch(spark)).collect()}
    good = {(a, b) for a, b in combinations(words, 2) if min(len(a), len(b)) > 3 and (spelling.lcs_ratio(a, b) >= names.SAME_WORD or names.swapped(a, b))}
    assert got <= good and len(got) / len(good) >= 0.9


def test_short_names_are_linked(spark):
    rows = [(i, n, "person", None, None, b, None, "tmdb", "", NOW, "x") for i, (n, b) in enumerate([("Bob Hill", None), ("Robert Hill", None), ("John Ford", "1950-01-01"), ("Jonh Ford", "1950-01-01"), ("Jon Ford", "1931-05-05"), ("Li", None), ("Li", ""), ("Wu", None)])]
    got = {r.person_id: r.entity for r in names.entities(spark.createDataFrame(rows, PERSON)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 5: 5, 6: 5}


def test_many_ratios_equal_single_ones():
    rng = random.Random(3)
    a, b = [["".join(rng.choice("abcdé王") for _ in range(rng.randint(0, 70))) for _ in range(300)] for _ in "ab"]
    assert np.allclose(spelling.lcs_ratios(a, b), [spelling.lcs_ratio(x, y) for x, y in zip(a, b)])
    assert len(spelling.lcs_ratios([], [])) == 0
