"""Filters, joins, counts, screening rules and selections over the article table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..learning.models import hard_vote, soft_vote, vote_decision, weighted_vote
from ..operators import active, filters, metrics, resample, rules
from ..plans import combine
from ..session import checkpoint
from ..sources import tables
from ..sources.tables import EXCLUSION, INCLUSION
from .registry import CLEAN, LABELS_CTE, MEMBERS, query, sql_jaccard, sql_words, with_articles

STRATEGY = {
    "population": ["the", "und", "que"],
    "intervention": ["license", "Worthless", "de la", "of the"],
    "comparison": [],
    "study_design": ["article", "review"],
}


def _contains(col, terms):
    return "(" + " OR ".join(f"contains({col}, '{t.lower()}')" for t in terms) + ")"


_BODY = "lower(title || chr(10) || abstract || chr(10) || keywords)"
STRATEGY_SQL = " AND ".join(
    _contains("lower(entry_type)" if k == "study_design" else _BODY, v) for k, v in STRATEGY.items() if v
)

# -- filters -------------------------------------------------------------------------------------------


@query("strategy_filter", with_articles(f"SELECT entry_id, title FROM articles WHERE {STRATEGY_SQL}"))
def strategy_filter(spark, sf_dir):
    return filters.strategy_filter(tables.articles(spark, sf_dir), STRATEGY).select("entry_id", "title")


@query(
    "date_range_filter",
    with_articles(
        "SELECT entry_id, year FROM articles WHERE TRY_CAST(year AS INT) BETWEEN 2005 AND 2012"
    ),
)
def date_range_filter(spark, sf_dir):
    found = filters.date_range_filter(tables.articles(spark, sf_dir), "2005-01-01", "2012-12-31")
    return found.select("entry_id", "year")


@query(
    "facet_filter",
    with_articles(
        """SELECT entry_id, keywords FROM articles
        WHERE lower(keywords) IN ('en', 'de') AND lower(source) IN ('src1', 'src2', 'src3')
          AND list_has_any([lower(entry_type), lower(keywords)], ['article', 'review'])"""
    ),
)
def facet_filter(spark, sf_dir):
    rows = tables.articles(spark, sf_dir).withColumn("publication_type", F.array("entry_type", "keywords"))
    facets = {
        "keywords": ["EN", "de"], "source": ["src1", "src2", "src3"], "entry_type": [],
        "publication_type": ["Article", "Review"],
    }
    return filters.facet_filter(rows, facets).select("entry_id", "keywords")


@query(
    "limit_results",
    with_articles(
        "SELECT source, entry_id FROM articles QUALIFY row_number() OVER (PARTITION BY source ORDER BY ord) <= 20"
    ),
)
def limit_results(spark, sf_dir):
    return filters.limit_results(tables.articles(spark, sf_dir), 20).select("source", "entry_id")


@query(
    "enabled_source_filter",
    with_articles("SELECT entry_id, source FROM articles WHERE source NOT IN ('src3', 'src5')"),
)
def enabled_source_filter(spark, sf_dir):
    on = {"src3": False, "src4": True, "src5": False}
    return filters.enabled_source_filter(tables.articles(spark, sf_dir), on).select("entry_id", "source")


@query(
    "lookup_by_id",
    with_articles(
        """SELECT a.entry_id, a.doi FROM articles a
        WHERE a.doi IN (SELECT '10.1000/' || md5(d.text) FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1)"""
    ),
)
def lookup_by_id(spark, sf_dir):
    toxic = tables.table(spark, sf_dir, "labels").filter("toxic = 1")
    ids = tables.table(spark, sf_dir, "documents").join(toxic, "doc_id").select(
        F.concat(F.lit("10.1000/"), F.md5("text")).alias("id")
    )
    return filters.lookup_by_id(tables.articles(spark, sf_dir), ids, "doi").select("entry_id", "doi")


@query("drop_empty_text", with_articles(f"SELECT entry_id, {CLEAN} AS clean FROM articles WHERE {CLEAN} <> ''"))
def drop_empty_text(spark, sf_dir):
    return filters.drop_empty_text(tables.articles(spark, sf_dir)).select("entry_id", "clean")


# -- rules ---------------------------------------------------------------------------------------------


def _first(terms):
    return "CASE " + " ".join(f"WHEN contains(body, '{t}') THEN '{t}'" for t in terms) + " END"


SCREENED_CTE = f"""
matched AS (SELECT *, {_first(EXCLUSION)} AS out_phrase, {_first(INCLUSION)} AS in_phrase
            FROM (SELECT *, lower(title || ' ' || abstract) AS body FROM articles)),
screened AS (SELECT * EXCLUDE (body, out_phrase, in_phrase),
  CASE WHEN out_phrase IS NOT NULL THEN 'exclude' WHEN in_phrase IS NOT NULL THEN 'include' ELSE 'uncertain' END AS decision,
  CASE WHEN out_phrase IS NOT NULL THEN '{rules.EXCLUDE_REASON}' || out_phrase
       WHEN in_phrase IS NOT NULL THEN '{rules.INCLUDE_REASON}' || in_phrase ELSE '{rules.UNCERTAIN_REASON}' END AS reason,
  CASE WHEN out_phrase IS NOT NULL THEN 0.9::DOUBLE WHEN in_phrase IS NOT NULL THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence
  FROM matched)"""


def screened(spark, sf_dir) -> DataFrame:
    return rules.rule_screen(tables.articles(spark, sf_dir), EXCLUSION, INCLUSION)


@query("rule_screen", with_articles("SELECT entry_id, decision, reason, confidence FROM screened", SCREENED_CTE))
def rule_screen(spark, sf_dir):
    return screened(spark, sf_dir).select("entry_id", "decision", "reason", "confidence")


@query("uncertain_subset", with_articles("SELECT entry_id, title FROM screened WHERE decision = 'uncertain'", SCREENED_CTE))
def uncertain_subset(spark, sf_dir):
    return rules.uncertain_subset(screened(spark, sf_dir)).select("entry_id", "title")


@query(
    "decision_counts",
    with_articles(
        """SELECT d.decision, count(s.entry_id) AS n
        FROM (SELECT unnest(['include', 'exclude', 'uncertain']) AS decision) d LEFT JOIN screened s USING (decision)
        GROUP BY ALL""",
        SCREENED_CTE,
    ),
)
def decision_counts(spark, sf_dir):
    return rules.decision_counts(screened(spark, sf_dir))


def predictions(spark, sf_dir, member: str = "a") -> DataFrame:
    """Given scores of a committee member for every article."""
    p = (F.col("ord") * MEMBERS[member] % 1000) / 1000
    rows = tables.articles(spark, sf_dir).select("entry_id", "ord", p.alias("probability"))
    return rows.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))


def _member_cte(member: str) -> str:
    return f"""
pred_{member} AS (SELECT *, (probability >= 0.5)::INT AS prediction FROM
  (SELECT entry_id, ord, ((ord * {MEMBERS[member]}) % 1000)::DOUBLE / 1000 AS probability FROM articles))"""


A, B, C = (_member_cte(m) for m in MEMBERS)


@query("prediction_counts", with_articles("SELECT prediction, count(*) AS n FROM pred_a GROUP BY ALL", A))
def prediction_counts(spark, sf_dir):
    return rules.prediction_counts(predictions(spark, sf_dir))


@query(
    "merge_decisions",
    with_articles(
        """SELECT s.entry_id,
          CASE WHEN use THEN CASE WHEN prediction = 1 THEN 'include' ELSE 'exclude' END ELSE decision END AS decision,
          CASE WHEN use THEN CASE WHEN prediction = 1 THEN probability ELSE 1 - probability END ELSE confidence END
            AS confidence,
          CASE WHEN use THEN probability END AS ml_probability
        FROM (SELECT s.*, p.prediction, p.probability, s.decision = 'uncertain' AND p.prediction IS NOT NULL AS use
              FROM screened s LEFT JOIN (SELECT * FROM pred_a WHERE probability < 0.9) p USING (entry_id)) s""",
        SCREENED_CTE,
        A,
    ),
)
def merge_decisions(spark, sf_dir):
    some = predictions(spark, sf_dir).filter("probability < 0.9")
    merged = rules.merge_decisions(screened(spark, sf_dir), some)
    return merged.select("entry_id", "decision", "confidence", "ml_probability")


# -- labels and counts ---------------------------------------------------------------------------------


@query(
    "join_seed_labels",
    with_articles("SELECT entry_id, title, label FROM articles JOIN seed_labels USING (entry_id)", LABELS_CTE),
)
def join_seed_labels(spark, sf_dir):
    labelled = rules.join_seed_labels(tables.articles(spark, sf_dir), tables.seed_labels(spark, sf_dir))
    return labelled.select("entry_id", "title", "label")


CLASS_SQL = f"""WITH {LABELS_CTE.strip()} SELECT count(*) FILTER (label = 1) AS positive,
  count(*) FILTER (label = 0) AS negative, count(*) AS n_samples FROM seed_labels"""


@query("class_distribution", CLASS_SQL)
def class_distribution(spark, sf_dir):
    return rules.class_distribution(tables.seed_labels(spark, sf_dir))


@query("training_guards", CLASS_SQL)
def training_guards(spark, sf_dir):
    labels = tables.seed_labels(spark, sf_dir)
    rules.training_guards(labels)
    return rules.class_distribution(labels)


@query(
    "selected_rows",
    with_articles(
        """SELECT entry_id, probability FROM pred_a
        WHERE entry_id IN (SELECT entry_id FROM pred_b ORDER BY 1.0 - abs(probability - 0.5) * 2 DESC, ord LIMIT 10)""",
        A,
        B,
    ),
)
def selected_rows(spark, sf_dir):
    chosen = active.select_uncertainty(predictions(spark, sf_dir, "b"))
    return rules.selected_rows(predictions(spark, sf_dir), chosen).select("entry_id", "probability")


@query(
    "source_counts",
    with_articles(
        "SELECT source, count(*) AS n FROM articles GROUP BY ALL UNION ALL SELECT 'combined', count(*) FROM articles"
    ),
)
def source_counts(spark, sf_dir):
    return filters.source_counts(tables.articles(spark, sf_dir))


@query(
    "union_sources",
    with_articles(
        """SELECT entry_id, source, title, year FROM articles
        UNION ALL SELECT 'benchmark_' || item_id, 'benchmark', text, NULL FROM benchmark"""
    ),
)
def union_sources(spark, sf_dir):
    other = tables.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("benchmark_"), F.col("item_id").cast("string")).alias("entry_id"),
        F.lit("benchmark").alias("source"),
        F.col("text").alias("title"),
    )
    return filters.union_sources(tables.articles(spark, sf_dir).select("entry_id", "source", "title", "year"), other)


@query(
    "jaccard_words",
    with_articles(
        f"""SELECT entry_id, {sql_jaccard('t', 'b')} AS title_abstract, {sql_jaccard('t', 'a')} AS title_author
        FROM (SELECT entry_id, {sql_words('title')} AS t, {sql_words('abstract')} AS b, {sql_words('author')} AS a
              FROM articles)"""
    ),
)
def jaccard_words(spark, sf_dir):
    rows = tables.articles(spark, sf_dir).select(
        "entry_id", tx.words("title").alias("t"), tx.words("abstract").alias("b"), tx.words("author").alias("a")
    )
    return rows.select(
        "entry_id",
        tx.jaccard(F.col("t"), F.col("b")).alias("title_abstract"),
        tx.jaccard(F.col("t"), F.col("a")).alias("title_author"),
    )


@query(
    "combine_sources",
    with_articles(
        rf"""SELECT CASE WHEN len(authors) = 0 THEN 'unknown'
               ELSE regexp_replace(lower(authors[1].last_name), '[^\p{{L}}\p{{N}}]', '', 'g') END || year || '_' || i
            AS entry_key, source, author, title, journal, year, abstract, doi, keywords
        FROM (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS i FROM (
          SELECT * FROM articles
          WHERE source NOT IN ('src3') AND {STRATEGY_SQL} AND TRY_CAST(year AS INT) BETWEEN 2001 AND 2018
            AND lower(keywords) IN ('en', 'fr', 'es')
          QUALIFY row_number() OVER (PARTITION BY source ORDER BY ord) <= 100))"""
    ),
)
def combine_sources(spark, sf_dir):
    everything = tables.articles(spark, sf_dir)
    wanted = combine.Search(
        strategy=STRATEGY, date_range=("2001-01-01", "2018-12-31"), facets={"keywords": ["en", "fr", "es"]},
        enabled={"src3": False}, max_results=100,
    )
    latin = F.col("keywords").isin("en", "fr")
    return combine.combine_sources([everything.filter(latin), everything.filter(~latin)], wanted)


# -- selections ----------------------------------------------------------------------------------------

UNCERTAINTY = "1.0 - abs(probability - 0.5) * 2"


@query(
    "select_uncertainty",
    with_articles(
        f"SELECT entry_id, probability, {UNCERTAINTY} AS uncertainty FROM pred_a ORDER BY uncertainty DESC, ord LIMIT 10", A
    ),
)
def select_uncertainty(spark, sf_dir):
    return active.select_uncertainty(predictions(spark, sf_dir)).select("entry_id", "probability", "uncertainty")


@query(
    "select_diversity",
    with_articles("SELECT entry_id, probability FROM pred_a ORDER BY md5(entry_id || '|42'), entry_id LIMIT 10", A),
)
def select_diversity(spark, sf_dir):
    return active.select_diversity(predictions(spark, sf_dir)).select("entry_id", "probability")


@query(
    "select_diversity_k_center",
    """
WITH RECURSIVE v AS (SELECT CAST(vec_id AS VARCHAR) AS entry_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS MATERIALIZED (
  SELECT a.entry_id AS a, b.entry_id AS b, 1.0 - list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS away
  FROM v a JOIN v b ON a.entry_id <> b.entry_id
), r AS (
  SELECT 1 AS step, a AS entry_id, away, a AS centre FROM (SELECT entry_id AS a, CAST('Infinity' AS DOUBLE) AS away FROM v ORDER BY md5(entry_id || '|42'), entry_id LIMIT 1)
  UNION ALL
  SELECT step, entry_id, away, centre FROM (
    WITH near AS (
      SELECT max(r.step) + 1 AS step, d.a, min(d.away) AS away FROM r JOIN d ON d.b = r.centre
      WHERE d.a NOT IN (SELECT centre FROM r) GROUP BY d.a
    ), best AS (SELECT step, a, away FROM near ORDER BY away DESC, a LIMIT 1)
    SELECT step, a AS entry_id, away, a AS centre FROM best
    UNION ALL SELECT (SELECT max(step) + 1 FROM r), entry_id, away, centre FROM r
  ) WHERE step <= 10
)
SELECT DISTINCT entry_id FROM r WHERE step = 10
""",
)
def select_diversity_k_center(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("entry_id"), "embedding")
    return active.select_diversity(rows, vector="embedding").select("entry_id")


@query(
    "select_combined",
    with_articles(
        f"""SELECT entry_id, probability FROM (SELECT * FROM pred_a ORDER BY {UNCERTAINTY} DESC, ord LIMIT 30)
        ORDER BY md5(entry_id || '|42'), entry_id LIMIT 10""",
        A,
    ),
)
def select_combined(spark, sf_dir):
    return active.select_combined(predictions(spark, sf_dir)).select("entry_id", "probability")


VOTES_CTE = """
votes AS (SELECT entry_id, min(ord) AS ord, count(prediction) AS votes, sum(prediction)::DOUBLE AS includes,
            round(var_pop(prediction), 9) AS disagreement
          FROM (SELECT * FROM pred_a UNION ALL SELECT * FROM pred_b WHERE probability > 0.1
                UNION ALL SELECT * FROM pred_c) GROUP BY entry_id)"""


def _members(spark, sf_dir) -> list[DataFrame]:
    members = [predictions(spark, sf_dir, m) for m in MEMBERS]
    members[1] = members[1].filter("probability > 0.1")
    return members


@query("committee_join", with_articles("SELECT entry_id, votes, includes, disagreement FROM votes", A, B, C, VOTES_CTE))
def committee_join(spark, sf_dir):
    joined = active.committee_join(_members(spark, sf_dir))
    return joined.select("entry_id", "votes", "includes", F.round("disagreement", 9).alias("disagreement"))


@query(
    "select_committee",
    with_articles(
        "SELECT entry_id, disagreement FROM votes ORDER BY disagreement DESC, ord LIMIT 10", A, B, C, VOTES_CTE
    ),
)
def select_committee(spark, sf_dir):
    chosen = active.select_committee(_members(spark, sf_dir))
    return chosen.select("entry_id", F.round("disagreement", 9).alias("disagreement"))


@query(
    "select_model_change",
    with_articles(
        f"SELECT entry_id, {UNCERTAINTY} AS expected_change FROM pred_c ORDER BY expected_change DESC, ord LIMIT 10", C
    ),
)
def select_model_change(spark, sf_dir):
    return active.select_model_change(predictions(spark, sf_dir, "c")).select("entry_id", "expected_change")


# -- ensembles on given scores, metrics, folds -----------------------------------------------------------


def _side_by_side(spark, sf_dir) -> DataFrame:
    wide = [
        ((F.col("ord") * k % 1000) / 1000).alias(f"p_{m}") for m, k in MEMBERS.items()
    ]
    return tables.articles(spark, sf_dir).select("entry_id", *wide)


SCORES_CTE = "scores AS (SELECT entry_id, " + ", ".join(
    f"((ord * {k}) % 1000)::DOUBLE / 1000 AS p_{m}" for m, k in MEMBERS.items()
) + " FROM articles)"


@query(
    "voting_ensemble",
    with_articles(
        """SELECT entry_id, soft, (soft > 0.5)::INT AS soft_decision, hard, (hard > 0.5)::INT AS hard_decision
        FROM (SELECT entry_id, (p_a + p_b + p_c) / 3 AS soft,
          ((p_a >= 0.5)::INT + (p_b >= 0.5)::INT + (p_c >= 0.5)::INT)::DOUBLE / 3 AS hard FROM scores)""",
        SCORES_CTE,
    ),
)
def voting_ensemble(spark, sf_dir):
    shares = [F.col(f"p_{m}") for m in MEMBERS]
    soft, hard = soft_vote(shares), hard_vote([(p >= 0.5).cast("int") for p in shares])
    return _side_by_side(spark, sf_dir).select(
        "entry_id", soft.alias("soft"), vote_decision(soft).alias("soft_decision"),
        hard.alias("hard"), vote_decision(hard, "hard").alias("hard_decision"),
    )


@query(
    "weighted_ensemble",
    with_articles(
        """SELECT entry_id, round(p, 9) AS probability, (p >= 0.4)::INT AS decision
        FROM (SELECT entry_id, p_a * (2.0::DOUBLE / 6) + coalesce(CASE WHEN p_b > 0.2 THEN p_b END, 0) * (1.0::DOUBLE / 6)
                + p_c * (3.0::DOUBLE / 6) AS p FROM scores)""",
        SCORES_CTE,
    ),
)
def weighted_ensemble(spark, sf_dir):
    shares = [F.col("p_a"), F.when(F.col("p_b") > 0.2, F.col("p_b")), F.col("p_c")]
    score = weighted_vote(shares, [2.0, 1.0, 3.0])
    return _side_by_side(spark, sf_dir).select(
        "entry_id", F.round(score, 9).alias("probability"), vote_decision(score, "weighted", 0.4).alias("decision")
    )


SCORED_CTE = """
scored AS (SELECT l.label, p.prediction, p.probability, (p.ord % 5)::INT AS fold
           FROM seed_labels l JOIN pred_a p USING (entry_id)),
confusion AS (SELECT fold, count(*) FILTER (prediction = 1 AND label = 1) AS tp,
    count(*) FILTER (prediction = 1 AND label = 0) AS fp, count(*) FILTER (prediction = 0 AND label = 1) AS fn,
    count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY fold),
ranked AS (SELECT fold, label, rank() OVER w + (count(*) OVER (PARTITION BY fold, probability) - 1) / 2.0 AS r
           FROM scored WINDOW w AS (PARTITION BY fold ORDER BY probability)),
measured AS (SELECT fold,
    CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1,
    CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision,
    CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
    CASE WHEN pos * neg = 0 THEN 'nan'::DOUBLE
         ELSE (rank_sum - pos * (pos + 1) / 2.0) / (pos * neg) END AS auc
  FROM confusion JOIN (SELECT fold, sum(r) FILTER (label = 1) AS rank_sum FROM ranked GROUP BY fold) USING (fold))"""


def scored_labels(spark, sf_dir) -> DataFrame:
    joined = tables.seed_labels(spark, sf_dir).join(predictions(spark, sf_dir), "entry_id")
    return joined.withColumn("fold", (F.col("ord") % 5).cast("int"))


@query(
    "binary_metrics",
    with_articles(
        "SELECT fold, " + ", ".join(f"round({m}, 9) AS {m}" for m in metrics.METRICS) + " FROM measured",
        LABELS_CTE, A, SCORED_CTE,
    ),
)
def binary_metrics(spark, sf_dir):
    table = metrics.binary_metrics(scored_labels(spark, sf_dir), ["fold"])
    return table.select("fold", *[F.round(m, 9).alias(m) for m in metrics.METRICS])


@query(
    "metric_summary",
    with_articles(
        """SELECT metric, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std
        FROM (UNPIVOT measured ON f1, precision, recall, auc INTO NAME metric VALUE value) GROUP BY metric""",
        LABELS_CTE, A, SCORED_CTE,
    ),
)
def metric_summary(spark, sf_dir):
    folds = metrics.long_metrics(metrics.binary_metrics(scored_labels(spark, sf_dir), ["fold"]))
    summary = metrics.metric_summary(folds)
    return summary.select("metric", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(
    "stratified_folds",
    f"""WITH {LABELS_CTE.strip()} SELECT entry_id, label,
      ((row_number() OVER (PARTITION BY label ORDER BY md5(entry_id || '|42'), entry_id) - 1) % 5)::INT AS fold
    FROM seed_labels""",
)
def stratified_folds(spark, sf_dir):
    return resample.stratified_folds(tables.seed_labels(spark, sf_dir)).select("entry_id", "label", "fold")


# -- resampling ------------------------------------------------------------------------------------------


def vectors(spark, sf_dir) -> DataFrame:
    """Embeddings as training rows; class 0 of ten is the minority."""
    return tables.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"),
        (F.col("label") == 0).cast("int").alias("label"),
        F.col("embedding").alias("features"),
    )


VECTORS_CTE = """
vectors AS (SELECT 'v' || vec_id AS id, (label = 0)::INT AS label FROM embeddings),
sizes AS (SELECT count(*) FILTER (label = 1) AS n_min, count(*) FILTER (label = 0) AS n_maj FROM vectors)"""


@query(
    "undersample",
    f"""WITH {VECTORS_CTE.strip()} SELECT id, label FROM vectors, sizes
    QUALIFY label = 1 OR row_number() OVER (PARTITION BY label ORDER BY md5(id || '|42'), id) <= floor(n_min / 0.8)""",
)
def undersample(spark, sf_dir):
    return resample.undersample(vectors(spark, sf_dir)).select("id", "label")


@query(
    "smote",
    f"""WITH {VECTORS_CTE.strip()} SELECT label, CASE label WHEN 1 THEN greatest(n_min, floor(0.5 * n_maj)::BIGINT)
      ELSE n_maj END AS n FROM sizes, (SELECT unnest([0, 1]) AS label)""",
)
def smote(spark, sf_dir):
    return resample.oversample(vectors(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


@query(
    "smote_rows",
    f"""WITH {VECTORS_CTE.strip()} SELECT n_min AS originals, greatest(n_min, floor(0.5 * n_maj)::BIGINT) - n_min AS made,
      true AS on_the_line, true AS near FROM sizes""",
)
def smote_rows(spark, sf_dir):
    """Every synthetic row lies between a minority row and one of that row's nearest."""
    rows = vectors(spark, sf_dir)
    minority = checkpoint(rows.where("label = 1"))
    sizes = resample.class_sizes(rows)
    n_new = int(resample.OVERSAMPLING_RATIO * sizes.n_maj) - sizes.n_min
    made = resample.synthetic_rows(minority, sizes.n_min, n_new, resample.NEIGHBOURS)
    near = resample.nearest_neighbours(minority, resample.NEIGHBOURS, sizes.n_min)
    ends = [minority.select(F.col("id").cast("string").alias(c), F.col("features").alias(f"{c}_at")) for c in ("from_id", "neighbour")]
    met = made.join(ends[0], "from_id").join(ends[1], "neighbour")
    met = met.join(near.select(F.col("id").alias("from_id"), "neighbour", F.lit(True).alias("near")), ["from_id", "neighbour"], "left")
    inside = F.forall(
        F.arrays_zip("features", "from_id_at", "neighbour_at"),
        lambda z: z["features"].between(F.least(z["from_id_at"], z["neighbour_at"]) - 1e-9, F.greatest(z["from_id_at"], z["neighbour_at"]) + 1e-9),
    )
    return met.agg(F.lit(sizes.n_min).cast("long").alias("originals"), F.count("*").alias("made"), F.bool_and(inside).alias("on_the_line"), F.bool_and(F.coalesce("near", F.lit(False))).alias("near"))


@query(
    "nearest_neighbours",
    f"""WITH {VECTORS_CTE.strip()}, v AS (SELECT 'v' || vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label = 0),
    d AS (SELECT a.id AS id, b.id AS neighbour, list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS away
          FROM v a JOIN v b ON a.id <> b.id)
    SELECT id, neighbour, CAST(row_number() OVER (PARTITION BY id ORDER BY away, neighbour) AS INT) AS slot FROM d
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY away, neighbour) <= 5""",
)
def nearest_neighbours(spark, sf_dir):
    """The neighbours that synthetic rows are drawn between."""
    rows = vectors(spark, sf_dir).where("label = 1")
    return resample.nearest_neighbours(rows, resample.NEIGHBOURS, rows.count()).select("id", "slot", "neighbour")


@query(
    "resample",
    f"""WITH {VECTORS_CTE.strip()}, grown AS (SELECT greatest(n_min, floor(0.5 * n_maj)::BIGINT) AS g, n_maj FROM sizes)
    SELECT label, CASE label WHEN 1 THEN g ELSE least(n_maj, floor(g / 0.8)::BIGINT) END AS n
    FROM grown, (SELECT unnest([0, 1]) AS label)""",
)
def resample_combined(spark, sf_dir):
    return resample.resample(vectors(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))

