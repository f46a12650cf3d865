"""Scans of hand-made source files, and round trips through the sinks."""

import json

import pytest
from pyspark.sql import functions as F

from reviewspark import sinks
from reviewspark.schema import screening_view
from reviewspark.sources import bibtex, databases, settings

BIB = """% a comment line
@article{smith2020_1,
    author = {Smith, Ann and Lee, Bo},
    title = "The {Big} study: a = b",
    year = 2020,
    month = jan # " " # {5},
    abstract = {Background: text
@home people (e.g. {nested {braces}}) read
more.},
    doi = {},
    keywords = {cancer, trial},
}
@comment{ignored, x = {y}}
@Book(jones_2,
  title = {Other}, number = 7, note = "say {"}hi{"}" , volume = {3}
)
  @misc{third, title={Same line}} @misc{fourth, title={Again}}
"""


@pytest.fixture()
def bib_dir(tmp_path):
    (tmp_path / "my_db_results.bib").write_text(BIB)
    (tmp_path / "b_results.bib").write_text("@article{k1,\n  title = {One}\n}\n\n@article{k2,\n  title = {Two}\n}\n")
    (tmp_path / "notes.txt").write_text("@article{no, title={No}}")
    return tmp_path


def test_scan_bibtex(spark, bib_dir):
    got = {r.entry_id: r for r in bibtex.scan_bibtex(spark, f"{bib_dir}/*_results.bib").collect()}
    assert set(got) == {"my_db_smith2020_1", "my_db_jones_2", "my_db_third", "my_db_fourth", "b_k1", "b_k2"}
    first = got["my_db_smith2020_1"]
    assert first.title == "The {Big} study: a = b"
    assert first.abstract == "Background: text @home people (e.g. {nested {braces}}) read more."
    assert first.source == "my_db" and first.entry_type == "article" and first.doi == ""
    assert first.keywords == ["cancer", "trial"] and first.keywords_str == "cancer, trial"
    assert [(a.last_name, a.first_name) for a in first.authors] == [("Smith", "Ann"), ("Lee", "Bo")]
    assert first.author == "Smith, Ann and Lee, Bo"
    assert first.extra == {"month": "January 5"}
    second = got["my_db_jones_2"]
    assert (second.entry_type, second.issue, second.volume) == ("book", "7", "3")
    assert second.extra["note"] == 'say {"}hi{"}'
    order = [r.entry_id for r in bibtex.scan_bibtex(spark, f"{bib_dir}/*_results.bib").orderBy("ord").collect()]
    assert order == ["b_k1", "b_k2", "my_db_smith2020_1", "my_db_jones_2", "my_db_third", "my_db_fourth"]


def test_scan_bibtex_over_small_splits(spark, tmp_path):
    entries = [f"@article{{k{i},\n  title = {{Title number {i}}},\n  year = {{{1990 + i}}}\n}}\n" for i in range(60)]
    (tmp_path / "x_results.bib").write_text("\n".join(entries))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = bibtex.scan_bibtex(spark, f"{tmp_path}/x_results.bib")
        assert df.rdd.getNumPartitions() > 1
        assert [r.entry_id for r in df.orderBy("ord").collect()] == [f"x_k{i}" for i in range(60)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_unclosed_entry_is_an_error(spark, tmp_path):
    (tmp_path / "x_results.bib").write_text("@article{k1,\n  title = {One\n")
    with pytest.raises(Exception, match="not closed"):
        bibtex.scan_bibtex(spark, f"{tmp_path}/x_results.bib").collect()


def test_bibtex_round_trip(spark, bib_dir, tmp_path):
    articles = bibtex.scan_bibtex(spark, f"{bib_dir}/*_results.bib")
    out = str(tmp_path / "out_results.bib")
    bibtex.write_bibtex(articles, out)
    again = bibtex.scan_bibtex(spark, out + "/part-*", prefix_keys=False)
    cols = ["entry_id", "title", "abstract", "year", "author", "keywords_str", "issue", "volume", "entry_type"]
    assert sorted(map(tuple, again.select(cols).collect())) == sorted(map(tuple, articles.select(cols).collect()))


PUBMED = """<?xml version="1.0"?><PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="1">11</PMID><Article><Journal><Title>J One</Title><JournalIssue>
<Volume>4</Volume><Issue>2</Issue><PubDate><Year>2019</Year></PubDate></JournalIssue></Journal>
<ArticleTitle>First trial</ArticleTitle><Pagination><MedlinePgn>1-9</MedlinePgn></Pagination>
<ELocationID EIdType="pii">S1</ELocationID><ELocationID EIdType="doi">10.1/x</ELocationID>
<Abstract><AbstractText Label="AIM">To see.</AbstractText><AbstractText>Plain.</AbstractText></Abstract>
<AuthorList><Author><LastName>O'Neil</LastName><ForeName>Ann B</ForeName><Initials>AB</Initials>
<AffiliationInfo><Affiliation>Place A</Affiliation></AffiliationInfo>
<AffiliationInfo><Affiliation>Place B</Affiliation></AffiliationInfo></Author>
<Author><CollectiveName>Group</CollectiveName></Author></AuthorList>
<PublicationTypeList><PublicationType UI="D1">Journal Article</PublicationType>
<PublicationType UI="D2">Review</PublicationType></PublicationTypeList></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="D9">Humans</DescriptorName></MeshHeading></MeshHeadingList>
<KeywordList Owner="N"><Keyword MajorTopicYN="N">lung</Keyword><Keyword MajorTopicYN="N">drug</Keyword></KeywordList>
</MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID Version="1">12</PMID><Article><Journal><Title>J Two</Title><JournalIssue>
<PubDate><MedlineDate>Spring 2001-2002</MedlineDate></PubDate></JournalIssue></Journal>
<ArticleTitle>Second</ArticleTitle><Abstract><AbstractText>Only text.</AbstractText></Abstract></Article>
</MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">12</ArticleId>
<ArticleId IdType="doi">10.2/y</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>0013</PMID><Article><Journal><Title>J Three</Title></Journal>
<ArticleTitle>Third</ArticleTitle></Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>"""


def test_scan_pubmed(spark, tmp_path):
    (tmp_path / "a.xml").write_text(PUBMED)
    rows = databases.scan_pubmed(spark, str(tmp_path), "1999").orderBy("ord").collect()
    a, b, c = rows
    assert (a.pmid, a.title, a.journal, a.year, a.volume, a.issue, a.pages, a.doi) == (
        "11", "First trial", "J One", "2019", "4", "2", "1-9", "10.1/x")
    assert a.abstract == "AIM: To see.\nPlain."
    assert a.authors[0].affiliation == "Place A" and a.author == "O'Neil, Ann B and , "
    assert a.keywords == ["Humans", "lung", "drug"]
    assert a.publication_type == ["Journal Article", "Review"]
    assert a.url == "https://pubmed.ncbi.nlm.nih.gov/11/" and a.entry_id == "pubmed_oneil2019_11"
    assert (b.year, b.doi, b.abstract, b.authors, b.keywords) == ("2001", "10.2/y", "Only text.", [], [])
    assert b.entry_id == "pubmed_unknown2001_12"
    assert (c.pmid, c.year, c.doi, c.abstract, c.volume) == ("0013", "1999", "", "", "")


def test_scan_scopus(spark, tmp_path):
    page = {"search-results": {"opensearch:totalResults": "3", "entry": [
        {"dc:title": "T1", "dc:identifier": "SCOPUS_ID:85", "prism:doi": "10.1/a/b", "prism:coverDate": "2021-03-01",
         "dc:creator": "Maria de Souza, Plato, ", "citedby-count": "5", "subtypeDescription": "Article"},
        {"dc:title": "T2", "dc:identifier": "SCOPUS_ID:86", "dc:creator": ""},
        {"dc:title": "T3"}]}}
    (tmp_path / "p.json").write_text(json.dumps(page))
    a, b, c = databases.scan_scopus(spark, str(tmp_path)).orderBy("ord").collect()
    assert (a.entry_id, a.scopus_id, a.year, a.citation_count) == ("scopus_10.1_a_b", "85", "2021", "5")
    assert [(p.last_name, p.first_name, p.initials) for p in a.authors] == [("Souza", "Maria de", "Md"), ("Plato", "", "")]
    assert a.author == "Souza, Maria de and Plato, "
    assert (b.entry_id, b.year, b.author, b.citation_count) == ("scopus_86", "", "", "0")
    assert c.entry_id.startswith("scopus_")


def test_scan_embase(spark, tmp_path):
    page = {"results": {"totalResults": "2", "entry": [
        {"embase_id": "L1", "title": "T", "abstract": "A", "journal": {"title": "J", "volume": "1", "issue": "2"},
         "startingPage": "5", "endingPage": "9", "publicationType": "Review", "publicationDate": "2018-05-01",
         "authors": [{"surname": "Ng", "given_name": "Bo", "initials": "B", "affiliation": "Place"}],
         "keywords": ["k1"], "mesh_terms": ["m1", {"term": "m2"}, {"other": 1}], "emtree_terms": [{"term": "e1"}, "k1"],
         "pubmed_id": "77"},
        {"embase_id": "L2"}]}}
    (tmp_path / "p.json").write_text(json.dumps(page))
    a, b = databases.scan_embase(spark, str(tmp_path)).orderBy("ord").collect()
    assert a.keywords == ["k1", "m1", "m2", "e1", "k1"]
    assert (a.entry_id, a.pages, a.journal, a.year, a.pubmed_id) == ("embase_ng2018_L1", "5-9", "J", "2018", "77")
    assert a.publication_type == ["Review"] and a.authors[0].affiliation == "Place"
    assert (b.entry_id, b.pages, b.year, b.publication_type) == ("embase_unknown_L2", "-", "", [])


CONFIG = {
    "search_strategy": {
        "search_terms": {"population": ["lung cancer", "NSCLC"], "study_design": []},
        "boolean_operators": {"within_category": "OR", "between_categories": "AND"}},
    "database_defaults": {"enabled": True, "max_results": 100, "languages": ["English"],
                          "date_range": {"start": "2020-01-01", "end": "2025-04-05"}},
    "databases": {"a": {"max_results": 500, "enabled": False}, "b": {"species": ["humans"]}},
    "screening": {"title_abstract": {"inclusion_criteria": ["x", "y"], "exclusion_criteria": ["z"]}}}


def test_settings(spark, tmp_path):
    path = str(tmp_path / "c.json")
    (tmp_path / "c.json").write_text(json.dumps(CONFIG, indent=2))
    criteria = settings.scan_criteria(spark, path)
    assert settings.criteria_phrases(criteria, "inclusion") == ["x", "y"]
    assert settings.criteria_phrases(criteria, "exclusion") == ["z"]
    terms = settings.scan_strategy(spark, path).orderBy("category", "ordinal").collect()
    assert [(t.category, t.term, t.within) for t in terms] == [("population", "lung cancer", "OR"), ("population", "NSCLC", "OR")]
    options = {r.source: r for r in settings.scan_source_options(spark, path, ["a", "b", "c"]).collect()}
    assert (options["a"].max_results, options["a"].enabled) == (500, False)
    assert (options["b"].max_results, options["b"].species, options["b"].languages) == (100, ["humans"], ["English"])
    assert options["c"].enabled is True and options["c"].date_range.start == "2020-01-01"


def test_seed_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text("entry_id,label,reason\na,1,x\nb,0,y\na,0,z\n")
    got = sorted(map(tuple, settings.scan_seed_labels(spark, str(tmp_path / "l.csv")).collect()))
    assert got == [("a", 0, "z"), ("b", 0, "y")]
    (tmp_path / "bad.csv").write_text("id,label\na,1\n")
    with pytest.raises(ValueError, match="entry_id"):
        settings.scan_seed_labels(spark, str(tmp_path / "bad.csv"))


def test_tables_and_subsets(spark, bib_dir, tmp_path):
    articles = bibtex.scan_bibtex(spark, f"{bib_dir}/*_results.bib")
    flat = sinks.entry_projection(articles)
    for kind in ("csv", "json", "parquet"):
        out = str(tmp_path / kind)
        sinks.write_table(flat, out, kind)
        reader = spark.read.format(kind).option("header", True).option("escape", '"').option("multiLine", kind == "csv")
        back = reader.load(out)
        assert sorted(r.entry_key for r in back.collect()) == sorted(r.entry_key for r in flat.collect())
        assert back.filter("entry_key = 'my_db_smith2020_1'").collect()[0].authors == "Smith, Ann, Lee, Bo"
    with pytest.raises(ValueError):
        sinks.write_table(flat, str(tmp_path / "x"), "xlsx")
    decided = screening_view(articles).withColumn(
        "decision", F.when(F.col("source") == "b", "include").otherwise("uncertain")
    )
    sinks.write_decision_subsets(decided, str(tmp_path / "subsets"))
    kept = bibtex.scan_bibtex(spark, f"{tmp_path}/subsets/uncertain_articles/part-*", prefix_keys=False)
    assert kept.count() == 4 and kept.filter("author != ''").count() == 1
    assert bibtex.scan_bibtex(spark, f"{tmp_path}/subsets/included_articles/part-*").count() == 2


def test_inline_markup_keeps_its_text(spark, tmp_path):
    record = (
        "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>The <i>E. <b>coli</b></i> H<sub>2</sub>O"
        " &lt;i&gt; case</ArticleTitle><Abstract><AbstractText Label=\"A\">before <i>inner</i> after <sup>2</sup> end</AbstractText>"
        "<AbstractText>plain <b>bold</b> tail <mml:math xmlns:mml=\"x\"><mml:mi>k</mml:mi></mml:math></AbstractText></Abstract></Article>"
        "<KeywordList><Keyword>the <i>gene</i> one</Keyword></KeywordList></MedlineCitation></PubmedArticle></PubmedArticleSet>"
    )
    (tmp_path / "r.xml").write_text(record)
    row = databases.scan_pubmed(spark, str(tmp_path), "1999").first()
    assert row.title == "The E. coli H2O <i> case"
    assert row.abstract == "A: before inner after 2 end\nplain bold tail k"
    assert row.keywords == ["the gene one"]


PAGE = '{"search-results": {"opensearch:totalResults": "2", "entry": %s}}'
ENTRY = '{"dc:title": "T%d", "dc:identifier": "SCOPUS_ID:%d", "citedby-count": %d}'


def test_result_pages_never_lose_records(spark, tmp_path):
    def titles(name, text, **options):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "p.json").write_text(text)
        return sorted((r.title, r.citation_count) for r in databases.scan_scopus(spark, str(folder), **options).collect())

    one, two = ENTRY % (1, 1, 3), ENTRY % (2, 2, 4)
    page = PAGE % f"[{one}, {two}]"
    assert titles("lines", page + "\n\n" + PAGE % one + "\n") == [("T1", "3"), ("T1", "3"), ("T2", "4")]
    assert titles("pretty", json.dumps(json.loads(page), indent=2), multi_line=True) == [("T1", "3"), ("T2", "4")]
    assert titles("empty", '{"search-results": {"opensearch:totalResults": "0"}}') == []
    for name, text in (("broken", page + "\n" + page[:60]), ("pretty2", json.dumps(json.loads(page), indent=2)), ("listless", '{"search-results": {}}')):
        with pytest.raises(Exception, match="p.json"):
            titles(name, text)


def test_broken_settings_and_labels_are_errors(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"screening": {"title_abstract": ')
    for scan in (settings.scan_criteria, settings.scan_strategy):
        with pytest.raises(Exception):
            scan(spark, str(tmp_path / "c.json")).collect()
    (tmp_path / "l.csv").write_text('entry_id,label,reason\na,1,"two\nlines, with ""quotes"""\nb,0,\n')
    rows = {r.entry_id: (r.label, r.reason) for r in settings.scan_seed_labels(spark, str(tmp_path / "l.csv")).collect()}
    assert rows == {"a": (1, 'two\nlines, with "quotes"'), "b": (0, "")}
    (tmp_path / "w.csv").write_text("entry_id,label,reason\na,yes,x\n")
    with pytest.raises(Exception, match="whole number"):
        settings.scan_seed_labels(spark, str(tmp_path / "w.csv")).collect()


def test_bibtex_keeps_every_field(spark, tmp_path):
    (tmp_path / "embase_results.bib").write_text("@article{k1,\n  title = {A},\n  publisher = {P},\n  month = jan,\n  volume = {3}\n}\n")
    articles = bibtex.scan_bibtex(spark, str(tmp_path / "embase_results.bib"))
    articles = articles.withColumn("pubmed_id", F.lit("77"))
    bibtex.write_bibtex(articles, str(tmp_path / "out"), bibtex.original_key())
    again = bibtex.scan_bibtex(spark, str(tmp_path / "out" / "part-*"), prefix_keys=False).first()
    assert (again.entry_id, again.title, again.volume, again.pmid) == ("k1", "A", "3", "77")
    assert again.extra == {"publisher": "P", "month": "January"}


def test_bibtex_does_not_depend_on_splits(spark, tmp_path):
    entries = [
        f"@article{{k{i},\n  title = {{Title {i}}},\n  abstract = {{first line\n@smith (2020) says\n@home people {{nested}}\nlast {i}}},\n  year = {2000 + i}\n}}"
        for i in range(12)
    ]
    (tmp_path / "x_results.bib").write_text("% head\n" + "\n".join(entries) + "\n@misc{last}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = set()
    try:
        for size in (20, 30, 45, 60, 90, 120, 200, 333, 1000, 100000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            rows = bibtex.scan_bibtex(spark, f"{tmp_path}/x_results.bib").orderBy("ord").collect()
            seen.add(tuple((r.entry_id, r.title, r.abstract, r.year) for r in rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(seen) == 1
    (rows,) = seen
    assert [r[0] for r in rows] == [f"x_k{i}" for i in range(12)] + ["x_last"]
    assert rows[3][2] == "first line @smith (2020) says @home people {nested} last 3"


def test_one_open_entry_costs_itself_only(spark, tmp_path):
    import time

    good = "\n".join(f"@article{{k{i},\n  title = {{T}}\n}}" for i in range(10000))
    (tmp_path / "y_results.bib").write_text("@article{bad,\n  title = {never closed\n" + good)
    start = time.time()
    assert bibtex.scan_bibtex(spark, f"{tmp_path}/y_results.bib", skip_broken=True).count() == 10000
    assert time.time() - start < 60
    with pytest.raises(Exception, match="y_results.bib"):
        bibtex.scan_bibtex(spark, f"{tmp_path}/y_results.bib").collect()


def test_macros_reach_entries_wherever_the_file_is_split(spark, tmp_path):
    entries = [f"@article{{k{i},\n  title = {{T{i}}},\n  journal = {'nat' if i % 2 else 'full'},\n  year = 2001,\n  month = jan,\n  note = nat # { {0: 'plain', 1: chr(34) + ', vol. ' + chr(34), 2: 'SCI'}[i % 3]}\n}}" for i in range(9)]
    text = (
        '@string{nat = "Nature"}\n@STRING(full = nat # " {Letters}"\n)\n@comment{x}\n' + "\n".join(entries)
        + '\n@string{nat = {Nat.\n@home edition}, sci = "Science"}\n' + "\n".join(e.replace("{k", "{m") for e in entries)
    )
    (tmp_path / "x_results.bib").write_text(text)
    (tmp_path / "y_results.bib").write_text("@article{k0, title = {T}, journal = nat}\n")

    def value(i, late):
        nat = "Nat. @home edition" if late else "Nature"
        tail = {0: "plain", 1: ", vol.", 2: "Science" if late else "SCI"}[i % 3]
        return (nat if i % 2 else "Nature {Letters}", f"{nat}{tail}")

    expected = [(f"x_k{i}", *value(i, False)) for i in range(9)] + [(f"x_m{i}", *value(i, True)) for i in range(9)] + [("y_k0", "nat", None)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (20, 30, 45, 60, 90, 120, 200, 333, 1000, 100000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            rows = bibtex.scan_bibtex(spark, f"{tmp_path}/*_results.bib").orderBy("ord").collect()
            assert [(r.entry_id, r.journal, r.extra.get("note")) for r in rows] == expected
            assert {(r.year, r.extra.get("month")) for r in rows[:-1]} == {("2001", "January")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_scopus_keys_do_not_depend_on_partitions(spark, tmp_path):
    page = lambda *titles: json.dumps({"search-results": {"entry": [{"dc:title": t} for t in titles]}})
    (tmp_path / "p.json").write_text("\n".join(page(f"a{i}", f"b{i}") for i in range(20)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = set()
    try:
        for size in (50, 300, 100000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            seen.add(tuple(sorted((r.title, r.entry_id) for r in databases.scan_scopus(spark, f"{tmp_path}/p.json").collect())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(seen) == 1 and len({e for _, e in next(iter(seen))}) == 40
