"""Duplicate passes: hand-worked branches, and a slow sequential twin on random articles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reviewspark.operators import dedup, exact, fates, similar, skew

FIELDS = "entry_id string, ord long, source string, title string, author string, year string, doi string"


def make(spark, rows):
    full = [(f"s_{i}", i, "s", r.get("title"), r.get("author"), r.get("year"), r.get("doi")) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, FIELDS).repartition(3)


def pairs_of(spark, rows):
    got = dedup.deduplicate(make(spark, rows)).pairs.collect()
    return {r.dup_id: (r.primary_id, round(r.confidence, 9), r.reason, r.status) for r in got}, len(got)


def twin(rows):
    """The duplicate rule as one sequential loop over the articles."""

    def jac(a, b):
        a, b = set(a.split()), set(b.split())
        return len(a & b) / len(a | b) if a and b else 0.0

    def names(author):
        last = []
        for name in (author or "").split(" and ") if author else []:
            words = name.split()
            last.append((name.split(",")[0].strip() if "," in name else (words[-1] if words else "")).lower())
        return " ".join(sorted(last))

    items = []
    for i, r in enumerate(rows):
        title = " ".join(re.sub(r"[^\w\s]", "", (r.get("title") or "").lower()).split())
        items.append((f"s_{i}", title, names(r.get("author")), r.get("year") or "", (r.get("doi") or "").lower().strip()))
    out, kept, left = {}, [], []
    for level in (1, 2):
        first = {}
        for it in items:
            key = it[4] if level == 1 else (not it[4] and it[1] and it[3] and (it[1], it[3]))
            if not key:
                continue
            if key in first:
                value = (1.0, exact.DOI_REASON) if level == 1 else (0.9, exact.TITLE_REASON)
                out[it[0]] = (first[key], *value, exact.CONFIRMED)
            else:
                first[key] = it[0]
                kept.append(it)
    left = [it for it in items if not it[4] and not (it[1] and it[3])]
    for it in left:
        best = (0.0, None, None)
        for u in kept:
            t, a = jac(it[1], u[1]), jac(it[2], u[2])
            if t > 0.8 and it[3] == u[3]:
                found = (t, u[0], similar.REASON_YEAR)
            elif t > 0.8 and a > 0.5:
                found = ((t + a) / 2, u[0], similar.REASON_AUTHOR)
            elif 0.5 < t <= 0.8 and it[3] == u[3] and a > 0.7:
                found = ((t + a) / 2, u[0], similar.REASON_BOTH)
            else:
                continue
            if found[0] > best[0]:
                best = found
        score, target, reason = best
        if score > 0.7:
            out[it[0]] = (target, round(score, 9), reason, exact.CONFIRMED)
            continue
        kept.append(it)
        if score > 0.5:
            out[it[0]] = (target, round(score, 9), reason, similar.REVIEW)
    return {k: (v[0], round(v[1], 9), v[2], v[3]) for k, v in out.items()}


TEN = "one two three four five six seven eight nine ten"

BRANCHES = [
    dict(title="Alpha beta", year="2001", doi="10.1/A "),
    dict(title="Other words here", year="2002", doi=" 10.1/a"),  # same identifier
    dict(title="Non-small cell: a study", year="2001"),
    dict(title="nonsmall CELL a   study!", year="2001"),  # same title and year
    dict(title="nonsmall cell a study", year="2001", doi="10.9/z"),  # an identifier keeps it out of pass two
    dict(title=TEN),
    dict(title=TEN + " eleven"),  # 10/11, blank years agree
    dict(title="red green blue grey", author="Smith, A and Jones, B"),
    dict(title="red green blue grey pink", author="Smith, A and Jones, B"),  # exactly 0.8: needs the authors
    dict(title="a1 b1 c1 d1 e1", author="Ng, X", year="2010"),
    dict(title="a1 b1 c1 d1 e1", author="X Ng"),  # years differ, same authors
    dict(title="a2 b2 c2 d2 e2", author="Ng, X", year="2010"),
    dict(title="a2 b2 c2 d2 e2", author="Li, X"),  # years differ, other authors: kept
    dict(title="p q", author=""),
    dict(title="p q r s", author=""),  # exactly 0.5: kept
    dict(title="", year="2010"),
    dict(title="", year="2010"),  # no title: kept
    dict(title="?!", year=""),
    dict(title="?!", year=""),  # a title without words: kept
    dict(title=None, author=None, year=None, doi=None),
    dict(title="k1 k2 k3 k4 k5 k6 k7 k8", author="A, x and B, x and C, x and D, x"),
    dict(title="k1 k2 k3 k4 k5 k9 k10", author="A, x and B, x and C, x and D, x and E, x"),  # 5/10, not above
    dict(title="k1 k2 k3 k4 k5 k6 k12 k13 k14", author="A, x and B, x and C, x and D, x and E, x"),  # borderline
    dict(title=TEN),  # copies of a kept article
    dict(title=TEN),
    dict(title=TEN + " eleven"),
]


def test_branches_match_the_sequential_rule(spark):
    got, n = pairs_of(spark, BRANCHES)
    expected = twin(BRANCHES)
    assert got == expected
    assert n == len(expected)
    assert got["s_1"] == ("s_0", 1.0, exact.DOI_REASON, exact.CONFIRMED)
    assert got["s_3"] == ("s_2", 0.9, exact.TITLE_REASON, exact.CONFIRMED)
    assert got["s_6"][:1] == ("s_5",) and got["s_6"][2] == similar.REASON_YEAR
    assert got["s_8"] == ("s_7", 0.9, similar.REASON_BOTH, exact.CONFIRMED)
    assert got["s_10"] == ("s_9", 1.0, similar.REASON_AUTHOR, exact.CONFIRMED)
    assert not {"s_12", "s_14", "s_16", "s_18", "s_19"} & set(got)


def random_articles(seed, n, words, authors):
    rnd = random.Random(seed)
    base = [[rnd.choice(words) for _ in range(rnd.randint(3, 9))] for _ in range(max(3, n // 6))]
    rows = []
    for _ in range(n):
        title = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            title[rnd.randrange(len(title))] = rnd.choice(words)
        names = rnd.sample(authors, rnd.randint(0, len(authors)))
        rows.append(
            dict(
                title=" ".join(title),
                author=" and ".join(f"{a}, x" for a in names),
                year=rnd.choice(["", "", "", "2001", "2002"]),
                doi=rnd.choice(["", "", "", "", f"10.1/{rnd.randint(0, n)}"]),
            )
        )
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_random_articles_match_the_sequential_rule(spark, seed):
    rows = random_articles(seed, 120, [f"w{i}" for i in range(12 + 4 * seed)], ["ann", "bob", "cid", "dan"])
    got, n = pairs_of(spark, rows)
    expected = twin(rows)
    assert got == expected
    assert n == len(expected)


def test_near_copies_that_improve_over_an_earlier_match(spark):
    rows = random_articles(11, 40, [f"w{i}" for i in range(9)], ["ann", "bob", "cid"]) * 3
    got, _ = pairs_of(spark, rows)
    assert got == twin(rows)


def test_crowded_keys_are_spread_without_changing_the_result(spark, monkeypatch):
    monkeypatch.setattr(similar, "ROWS_PER_TASK", 3)
    monkeypatch.setattr(exact, "ROWS_PER_TASK", 3)
    rows = random_articles(5, 90, [f"w{i}" for i in range(10)], ["ann", "bob"]) + [
        dict(title="hot title copied often", year="2001") for _ in range(40)
    ] + [dict(title="hot title without year") for _ in range(40)]
    got, n = pairs_of(spark, rows)
    expected = twin(rows)
    assert got == expected and n == len(expected)


def test_near_copies_with_words_of_their_own_become_one_target(spark):
    core = "a large group of near copies with one common core"
    rows = [dict(title=f"{core} id{i}", year="", doi=f"10.1/{i}") for i in range(30)]
    rows += [dict(title=f"{core} id{i}") for i in range(100, 140)] + [dict(title=f"{core} id7")]
    got, n = pairs_of(spark, rows)
    expected = twin(rows)
    assert got == expected and n == len(expected)
    _, kept, leftovers = dedup.exact_passes(make(spark, rows))
    leftovers, kept = similar.with_words(leftovers), similar.with_words(kept)
    sources, targets = similar.leftover_signatures(leftovers), similar.target_signatures(kept)
    assert targets.count() == 30
    assert similar.first_of_equal_targets(sources, targets).count() == 2


def test_salted_join_equals_plain_join(spark):
    left = spark.range(200).select(F.when(F.col("id") < 150, "hot").otherwise(F.col("id").cast("string")).alias("key"), "id")
    right = left.select("key").distinct().withColumn("v", F.length("key"))
    sizes = left.groupBy("key").agg(F.count("*").alias("n"))
    hot = skew.hot_keys(sizes, "key", "n", 10)
    assert [(r._salts) for r in hot.collect()] == [15]
    got = skew.salted_join(left, right, "key", hot, F.col("id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "key").collect()))


def test_last_value_wins_keeps_first_position(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "entry_id string, ord long, title string")
    got = sorted(map(tuple, exact.last_value_wins(df).collect()))
    assert got == [("a", 1, "z"), ("b", 2, "y")]


def test_report_and_flow_counts(spark):
    articles = make(spark, BRANCHES)
    result = dedup.deduplicate(articles)
    report = dedup.duplicate_report(articles, result.pairs)
    assert report.count() == result.pairs.count()
    assert set(report.columns) >= {"primary_source", "duplicate_title", "confidence", "reason", "status"}
    counts = {r.stage: r.n for r in dedup.flow_counts(articles, result.pairs).collect()}
    assert counts["identified"] == len(BRANCHES)
    assert counts["unique"] == result.unique.count() == counts["identified"] - counts["duplicates_removed"]
    assert counts["borderline"] >= 1


def test_repeated_entry_ids_are_one_article(spark):
    """The later values at the first place; everything that follows sees one article per id."""
    rows = [
        ("k1", "First words of a study", "Doe, Jane", "2001", "10.1/old"),
        ("k2", "Second study on other things", "Roe, Max", "2002", "10.1/old"),
        ("k1", "First words of a study revised", "Doe, Jane", "2001", "10.1/new"),
        ("k3", "Third study", "Poe, Ann", "2003", ""),
        ("k3", "Third study", "Poe, Ann", "2003", ""),
        ("k4", "Third study", "Poe, Ann", "2003", ""),
        ("k4", "Third study", "Poe, Ann", "2003", ""),
    ]
    data = [(k, n, t, a, y, d, "s") for n, (k, t, a, y, d) in enumerate(rows)]
    articles = spark.createDataFrame(data, "entry_id string, ord long, title string, author string, year string, doi string, source string")
    result = dedup.deduplicate(articles)
    assert [(r.primary_id, r.dup_id) for r in result.pairs.collect()] == [("k3", "k4")]
    unique = {r.entry_id: r.title for r in result.unique.collect()}
    assert unique == {"k1": "First words of a study revised", "k2": "Second study on other things", "k3": "Third study"}
    assert result.unique.count() == 3
    assert dedup.duplicate_report(articles, result.pairs).count() == 1
    counts = {r.stage: r.n for r in dedup.flow_counts(articles, result.pairs).collect()}
    assert counts["identified"] == 7 and counts["duplicates_removed"] == 1 and counts["unique"] == 3


# -- index and fates ------------------------------------------------------------------------------------


def sequential_fates(n, edges):
    earlier = {}
    for item, other in edges:
        earlier.setdefault(item, []).append(other)
    kept = []
    for i in range(n):
        kept.append(not any(kept[j] for j in earlier.get(i, [])))
    return {i for i in range(n) if not kept[i]}


@pytest.mark.parametrize("task_edges", [300, 200_000])
def test_fates_equal_the_sequential_rule(spark, task_edges):
    draw = random.Random(task_edges)
    n = 900
    edges = {(i, i - 1) for i in range(1, 300)} | {(i, i - 2) for i in range(2, 300)}  # a chain that only a sequence settles
    edges |= {(i, j) for i in range(300, 340) for j in range(300, i)}  # a group of copies
    edges |= {tuple(sorted(draw.sample(range(340, 640), 2), reverse=True)) for _ in range(500)}
    edges |= {tuple(sorted(draw.sample(range(640, n), 2), reverse=True)) for _ in range(90)}
    order = draw.sample(range(10_000), n)  # numbers say nothing about places
    rows = [(order[i], i, order[j]) for i, j in edges]
    got = fates.gone(spark.createDataFrame(rows, "item long, place long, earlier long"), task_edges).collect()
    assert sorted(r.item for r in got) == sorted(order[i] for i in sequential_fates(n, edges))


def test_a_chain_of_ten_thousand_titles_needs_few_rounds(spark, monkeypatch):
    rounds, plain = [], fates._settle_bin
    monkeypatch.setattr(fates, "checkpoint", lambda df, f=fates.checkpoint: rounds.append(1) or f(df))
    assert plain is fates._settle_bin
    titles = [" ".join(f"w{k}" for k in range(i, i + 12)) for i in range(10_000)]  # each a sure match of its neighbours only
    df = spark.createDataFrame([(f"s_{i}", i, t, "", "", "") for i, t in enumerate(titles)], "entry_id string, ord long, title string, author string, year string, doi string")
    pairs = dedup.duplicate_pairs(df)
    gone = {r.dup_id for r in pairs.where(F.col("status") == exact.CONFIRMED).collect()}
    assert gone == {f"s_{i}" for i in range(1, 10_000, 2)}
    assert len(rounds) <= 3 + 4 * 20


def test_index_rows_grow_with_the_title_not_with_the_authors(spark):
    def rows(authors):
        words = [f"a{k}" for k in range(authors)]
        df = spark.createDataFrame([(0, 0, [f"t{k}" for k in range(12)], words, None)], "num long, ord long, title_words array<string>, author_words array<string>, no_year boolean")
        index = similar.index_rows(df, similar.word_frequencies(df))
        assert set(index.columns) == {"num", "ord", "t", "a", "key", "at", "title_tenths", "author_tenths"}
        return index.count()

    few, many = rows(3), rows(5000)
    assert few < many <= 12 * 2 * similar.AUTHOR_SLOTS + 12


def test_a_pair_is_verified_once(spark):
    rows = [dict(title="one two three four five six seven eight", author="A, B and C, D and E, F", doi=f"10/{k}") for k in range(4)]
    rows += [dict(title="one two three four five six seven nine", author="A, B and C, D and E, F")]
    _, kept, leftovers = dedup.exact_passes(make(spark, rows))
    match = similar.match_signatures(similar.with_words(leftovers), similar.with_words(kept), every_target=True)
    pairs = similar.candidates(match.source_index, match.target_index, None)
    assert pairs.count() == pairs.distinct().count() > 0


def test_grid_join_equals_plain_join(spark):
    left = spark.range(300).select(F.when(F.col("id") < 250, 1).otherwise(F.col("id")).alias("key"), "id")
    right = spark.range(1000, 1200).select(F.when(F.col("id") < 1150, 1).otherwise(F.col("id") - 1000).alias("r_key"), F.col("id").alias("r_id"))
    hot = skew.crowded_pairs(left, right.withColumnRenamed("r_key", "key"), "key", 100, 40)
    assert [(r.key, r._rows, r._columns) for r in hot.collect()] == [(1, 7, 4)]
    test = F.col("id") % 3 != F.col("r_id") % 3
    got = skew.grid_join(left, right, "key", hot, F.col("id"), F.col("r_id"), test).select("key", "id", "r_id")
    expected = left.join(right, (F.col("key") == F.col("r_key")) & test).select("key", "id", "r_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_dedup_with_hot_keys_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(similar, "PAIRS_PER_TASK", 20)
    monkeypatch.setattr(similar, "SIDE_PER_TASK", 3)
    draw = random.Random(17)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows = [dict(title=" ".join(draw.sample(words, draw.randint(3, 6))), author=draw.choice(["", "A, B and C, D", "A, B"]), year=draw.choice(["", "", "2001"]), doi=draw.choice(["", "", f"10/{k}"])) for k in range(90)]
    got, n = pairs_of(spark, rows)
    expected = twin(rows)
    assert got == expected and n == len(expected)


def test_bits_drop_pairs_of_a_key_that_differ_in_too_many_words(spark):
    """One rare word and the authors in common, the other words all different: compared with no one."""
    common = [f"common{k}" for k in range(8)]
    rows = [dict(title=" ".join(common), doi=f"10/c{k}") for k in range(9)]
    rows += [dict(title=" ".join(["rare", *(f"x{k}v{j}" for j in range(7))]), author="A, B", doi=f"10/{k}") for k in range(20)]
    rows += [dict(title=" ".join(["rare", *(f"y{k}v{j}" for j in range(7))]), author="A, B") for k in range(20)]
    rows += [dict(title=" ".join(["rare", *(f"x{k}v{j}" for j in range(6)), "other"]), author="A, B") for k in range(20)]
    _, kept, leftovers = dedup.exact_passes(make(spark, rows))
    match = similar.match_signatures(similar.with_words(leftovers), similar.with_words(kept), every_target=True)
    assert similar.candidates(match.source_index, match.target_index, None).count() <= 25
    assert match.target_matches().count() == 20


@pytest.mark.parametrize("seed", range(3))
def test_bits_never_drop_a_match(spark, seed):
    """Titles of many words, so that words share bits."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    bases = [draw.sample(words, draw.randint(30, 120)) for _ in range(8)]
    rows = []
    for k in range(60):
        base = draw.choice(bases)
        title = draw.sample(base, draw.randint(len(base) // 2, len(base))) + draw.sample(words, draw.randint(0, 12))
        rows.append(dict(title=" ".join(title), author=draw.choice(["A, B", "A, B and C, D and E, F"]), year=draw.choice(["", "", "2001"]), doi=draw.choice(["", "", f"10/{k}"])))
    got, n = pairs_of(spark, rows)
    expected = twin(rows)
    assert got == expected and n == len(expected) > 0


def test_the_passes_read_the_articles_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(title):
        seen.add(1)
        return title

    articles = make(spark, BRANCHES).withColumn("title", F.udf(look, "string")("title"))
    pairs, kept, leftovers = dedup.exact_passes(articles)
    assert pairs.count() and kept.count() and leftovers.count()
    assert seen.value == len(BRANCHES)


def test_unique_articles_moves_no_abstracts(spark, tmp_path):
    from reviewspark.checks import dedup_queries

    docs = [(k, "s", "en", f"a{k} b{k} c{k} d{k}.\nBody {k}", 30) for k in range(12)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = dedup_queries.unique_articles(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "abstract" not in plan and "journal" not in plan
    assert got.count() == 12
