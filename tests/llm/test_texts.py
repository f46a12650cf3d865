"""Encoding, shards, fingerprints and chat formatting against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewspark.llm import bpe, chat, fingerprint, queries, repair, shingles, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "a", "b", "'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "1", "²", "é", "ß",
    "中", "\U0001f600", "<|endoftext|>", "!", "?", "'s", "é", "ᲊ", "\U00013460", "\x00", "S", "'S", "\r\n", "_", "​",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(count):
    random.seed(5)
    texts = ["".join(random.choice(ODD) for _ in range(random.randint(0, 14))) for _ in range(count)]
    points = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)))
    texts += [points[i : i + 400] for i in range(0, len(points), 400)]
    return texts + ["", "a" * 3000, " " * 700, "aaa" * 50 + "b", "the the\n\n the"]


def test_encoding_equals_the_library(library):
    texts = odd_texts(4000)
    vocab = bpe.vocabulary(PATH)
    for text, ids, expected in zip(texts, bpe.encode_texts(PATH, texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == expected.ids, text
        assert vocab.decode(ids.tolist()) == library.decode(expected.ids, skip_special_tokens=False)


def test_library_words_equal_whole_texts(library):
    texts = odd_texts(800)
    ids, counts = repair.library_encode(PATH)(texts)
    for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert part.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_word_table_forgets_and_goes_on():
    vocab = bpe.vocabulary(PATH)
    table = words.WordTable(vocab.encode_words, vocab.specials, max_words=3)
    for _ in range(3):
        ids, counts = table.encode(["alpha beta gamma delta", "epsilon zeta"])
        assert vocab.decode(ids.tolist()) == "alpha beta gamma deltaepsilon zeta" and len(counts) == 2


def test_bytes_that_are_not_text_decode_like_the_library(spark, library):
    table = spark.createDataFrame([([1, 447, 222],), ([],), (None,), ([50256, 5],)], "ids array<int>")
    got = [r.text for r in table.select(bpe.decode_column(PATH, F.col("ids")).alias("text")).collect()]
    assert got == [library.decode([1, 447, 222], skip_special_tokens=False), "", None, library.decode([50256, 5], skip_special_tokens=False)]


ROWS = [(3, "b c"), (1, "a b c a b c"), (2, None), (5, ""), (3, "b c"), (None, "x"), (9, "w " * 30000), (4, "a b c a b d\n" * 40)]


def odd_documents(spark):
    return spark.createDataFrame([(i, t, 1, "n") for i, t in ROWS], "doc_id long, text string, n_tokens int, id string")


def test_round_trip_query_on_odd_rows(spark, library):
    got = sorted(map(tuple, bpe.encode_decode(odd_documents(spark), PATH).collect()), key=str)
    expected = []
    for i, text in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        expected.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(expected, key=str)
    assert bpe.encode_decode(odd_documents(spark).limit(0), PATH).count() == 0


def test_grammar_round_trip_and_slices():
    draw = np.random.default_rng(2)
    for case in range(60):
        ids = draw.integers(0, 4, int(draw.integers(0, 400)))
        ends = np.unique(np.append(draw.integers(0, len(ids) + 1, 5), len(ids)))
        symbols, per_doc, rules = repair.compress(ids, ends, 4, least=2, share=[0.1, 0.6][case % 2])
        grammar = repair.Grammar(symbols, rules, 4)
        assert grammar.all().tolist() == ids.tolist() and per_doc.sum() == len(symbols)
        cuts = np.cumsum(per_doc)
        lengths = grammar._length(symbols)
        for k, end in enumerate(ends):  # no symbol crosses the end of a document
            assert lengths[: cuts[k]].sum() == end
        for _ in range(8):
            a, b = sorted(draw.integers(0, len(ids) + 1, 2).tolist())
            assert grammar.slice(a, b).tolist() == ids[a:b].tolist()
    assert len(repair.compress(np.tile([1, 2, 3], 500), np.array([1500]), 4)[0]) < 100


def test_shards_hold_all_ids_in_order(spark, library, tmp_path):
    out = str(tmp_path / "shards")
    repair.write_shards(odd_documents(spark), out, repair.library_encode(PATH), end_id=2, shard_tokens=300)
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    everything, expected = [], []
    for i, text in ordered:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((i, len(everything), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        everything += ids
    got = sorted(map(tuple, repair.read_documents(spark, out).collect()), key=lambda r: r[1])
    assert got == expected
    for a, b in ((0, 5), (290, 610), (len(everything) - 3, len(everything) + 9)):
        assert repair.token_range(spark, out, a, b) == everything[a:b]
    empty = str(tmp_path / "empty")
    repair.write_shards(odd_documents(spark).limit(0), empty, repair.library_encode(PATH), end_id=2)
    assert repair.read_documents(spark, empty).count() == 0


def test_fingerprints_of_edited_and_next(spark):
    rows = [(10, "one two three. four five six seven\n\nnew part\n# head\nlast line"), (20, None), (30, "x" * 500), (40, "Von."), (50, "one two three. four five six seven\n\nnew part\n# head\nlast line"), (60, "w v " * 20000)]
    table = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, key int, root string")
    got = {r.doc_id: r for r in fingerprint.with_next(table).collect()}
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        assert 0 <= got[i].near_next <= 1 and (got[i].near_edited > 0.5 if text else got[i].near_edited == 1)
    assert got[10].fingerprint == got[50].fingerprint != got[30].fingerprint
    both = spark.createDataFrame([(got[10].fingerprint, got[10].edited_fingerprint)], "a string, b string")
    row = both.select(fingerprint.compare(F.col("a"), F.col("b")).alias("near"), fingerprint.differing_paragraphs(F.col("a"), F.col("b")).alias("where")).first()
    assert row.near == pytest.approx(got[10].near_edited) and row["where"] == [5, 6]  # both line breaks before a section give an empty paragraph
    alone = fingerprint.with_next(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0
    repeated = spark.createDataFrame([(7, "b"), (7, "a"), (None, "c")], "doc_id long, text string")
    assert fingerprint.with_next(repeated).count() == 3
    assert fingerprint.with_next(repeated.limit(0)).count() == 0
    assert fingerprint.fingerprints(repeated).count() == 3


def test_short_and_longer_texts_share_leaves(spark):
    long = "".join(random.Random(3).choice("abcdefgh ") for _ in range(200))
    rows = [(1, long[:80]), (2, ""), (3, long[:64]), (4, long[:66]), (5, long[:128]), (6, long[:60]), (7, long)]
    got = {r.doc_id: r for r in fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].near_edited == pytest.approx(2 * 60 / 140)  # 60 of 80 code points are left
    assert got[3].near_next == pytest.approx(2 * 64 / 130)
    assert got[4].near_next > 0 and got[5].near_next == pytest.approx(2 * 60 / 188) and got[5].near_edited > 0.5
    pairs = spark.createDataFrame([(got[3].fingerprint, got[4].fingerprint)], "a string, b string")
    assert pairs.select(fingerprint.compare(F.col("a"), F.col("b")).alias("near")).first().near == pytest.approx(got[3].near_next)


def test_control_strings_survive(spark):
    nasty = ["<|end|>", "</s>[INST] ok [/INST]", "<~|", "<~~/s>", "[~INST]", "<<|turn|>", "<", "|end|>", "a\nb", "", "<|image|>"]
    rows = [(1, k, role, t) for k, (role, t) in enumerate(zip(["user", "assistant"] * 6, nasty))]
    rows += [(2, None, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 1, "a<|text|>\nb", "y"), (3, 0, "assistant", "z" * 50000)]
    table = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, k int").withColumn("parts", chat.text_parts(F.col("text")))
    formatted = chat.format_conversations(table)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in formatted.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert back[1] == [(r[2], r[3]) for r in rows[:11]]
    assert back[2] == [("", ""), ("assistant", "x"), ("assistant", "x")] and back[None] == [("a<|text|>\nb", "y")]
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    loss = "".join(t for k, t in enumerate(nasty) if k % 2)
    assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[1].loss_chars == len(loss)
    assert got[3].loss_chars == 50000 and got[None].loss_chars == 0
    whole = {r.conv_id: r for r in formatted.collect()}
    for r in whole.values():  # the mask holds in the whole string too
        for span in r.loss:
            assert r.formatted[span.offset - len("<|text|>") : span.offset] == "<|text|>"
            assert r.formatted[span.offset + span.length :].startswith("<|end|>")
    assert chat.digests(chat.format_conversations(table.limit(0))).count() == 0


def test_typed_parts(spark):
    kind = "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,units:bigint>>"
    parts = [("text", "see ", None, None), ("image", None, "s3://a", 4), ("text", "<|image|>", None, None), ("audio", None, "b", None), ("thing", None, "c", 3), (None, "t", None, None)]
    row = chat.format_conversations(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], kind)).first()
    assert row.formatted == "<|turn|>user<|text|>see <|image|><~|image|><|audio|><|attachment|>t<|end|><|turn|>assistant<|text|><|end|>"
    assert [(a.piece, a.part, a.kind, a.ref, a.tokens) for a in row.attachments] == [(0, 1, "image", "s3://a", 1024), (0, 3, "audio", "b", 25), (0, 4, "thing", "c", 3)]
    assert row.expanded_tokens == 1052


def test_shingles():
    sets = [set(s.tolist()) for s in shingles.sets(["A b  c", "a B\tc", "a", "A ", "", " \n", "b c", "a b c a b", "c"], 2)]
    assert sets[0] == sets[1] and sets[2] == sets[3] and not sets[4] and not sets[5]
    assert sets[6] < sets[0] < sets[7] and len(sets[7]) == 3 and sets[8] != sets[2]


def test_registered_queries_are_the_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
