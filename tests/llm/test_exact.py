"""Chat formatting (5), decontamination (7), SentencePiece (8), WARC (10), and the pipeline: exact results."""

import base64
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from oracle import duck_rows, plain, spark_rows

import corpus_pipeline
from textloom.llm import chat, decontaminate, pieces, simhash, stages, warc
from textloom.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_queries_match_sql(spark, data, name):
    assert spark_rows(Q.QUERIES[name](spark, data)) == duck_rows(data, Q.ORACLE_SQL[name])


def test_chat_reads_back_everything(spark):
    odd = ["", "\\", "\\\\", "<s>", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "<|im_next|>", "<<SYS>>x<</SYS>>", "a\nb", "<\\|im_end|>", "é😀", "[\\INST]"]
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system", "odd\nrole", "<s>", ""]), r.choice(odd) + r.choice(odd)) for c in range(40) for t in range(r.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.formatted(df)
    got = {x.conv_id: [(t.role, t.text) for t in x.turns] for x in chat.read_back(made).collect()}
    assert got == {c: [(a, b) for k, _, a, b in sorted(rows) if k == c] for c in range(40)}
    inside = made.first().formatted
    assert "<s>" not in inside.replace("<\\s>", "")


def test_chat_nulls_ties_and_empty(spark):
    rows = [(None, None, None, None), (1, 1, "user", None), (1, 1, "user", "b"), (1, 1, "user", "b"), (1, None, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(chat.formatted(df)).collect()}
    assert got == {None: (1, 0), 1: (4, 1)}
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


DOCS = [(1, "A b c d e f g h i j k l m n o"), (2, "x a b c d e f g h i j k l m z"), (2, "x a b c d e f g h i j k l m z"), (3, None), (4, ""), (None, "p q r! s"), (5, "p q r s t p q r"), (6, "a b c d e f g h i j k l"), (7, "É q"), (8, " ".join(f"w{i}" for i in range(3000)) + " p q r s")]
ITEMS = [(10, "a b c d e f g h i j k l m n o p q"), (11, "p q r"), (12, "p q r s"), (None, "é q"), (13, None), (14, "r s"), (15, " ".join(f"w{i}" for i in range(500, 540))), (11, "p q r")]


@pytest.mark.parametrize("most", [0, 200_000])
def test_contamination_both_ways(spark, most, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(DOCS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.register("benchmark", pd.DataFrame(ITEMS, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    want = sorted((plain(r) for r in con.execute(decontaminate.ORACLE).fetchall()), key=repr)
    assert sorted((plain(tuple(r)) for r in decontaminate.digests(decontaminate.contamination(docs, items)).collect()), key=repr) == want
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def test_encoding_equals_the_library(spark, documents, odd, library):
    for df in (documents, odd):
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = library.encode(r.text or "", add_bos=True, add_eos=True)
            digest = hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
            want.append((r.doc_id, len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        assert sorted(map(tuple, pieces.digests(df).collect()), key=repr) == sorted(want, key=repr)


def test_random_texts_and_ids(library):
    c, r = pieces.Codec(pieces.load(pieces.model_path())), random.Random(8)
    parts = [*"aabcdeéßñ  ▁▁\n\t.,12<>s/|*ThEe", "ing", "tion", "梦", "　", "😀", "й", "\x00", "ation", "      ", "the ", "        "]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert c.encode(t).tolist() == ids and c.decode(ids) == library.decode(ids)
    for _ in range(1000):
        ids = [r.randrange(32000) if r.random() < 0.5 else r.randrange(3, 262) for _ in range(r.randint(0, 8))]
        assert c.decode(ids) == library.decode(ids)
    long = "".join(r.choice(parts) for _ in range(100_000))
    assert c.encode(long).tolist() == library.encode(long, add_bos=True, add_eos=True)


def test_warc_round_trip(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html")
    extra = spark.createDataFrame([(900, "u", None), (901, None, ""), (902, "a\r\nb%c é", "x\r\n\r\nWARC/1.1 y"), (903, "u", "x\r\n\r\nWARC/1.1 y"), (903, "u", "x\r\n\r\nWARC/1.1 y"), (None, "n", "x\r\n\r\nWARC/1.1 y"), (904, "v", "z" * 500_000)], pages.schema)
    rows = pages.union(extra).collect()
    first = {}
    for r in rows:
        k = r.html or ""
        first[k] = min([x for x in (first.get(k), r.page_id) if x is not None], default=None)
    want = []
    for r in rows:
        body = (r.html or "").encode()
        own = first[r.html or ""] == r.page_id
        want.append((r.page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if own else "revisit", None if own else first[r.html or ""]))
    df = pages.union(extra).withColumn("digest", pages["page_id"])
    assert sorted(map(tuple, warc.round_trip(df.repartition(5)).collect()), key=repr) == sorted(want, key=repr)
    index, root = warc.write_archives(df)
    one = warc.read_archives(index.where("page_id = 902"), root).collect()
    assert [(r.url, bytes(r.payload).decode()) for r in one] == [("a\r\nb%c é", "x\r\n\r\nWARC/1.1 y")]
    assert warc.round_trip(df.limit(0)).count() == 0


def test_small_payloads_are_no_revisits(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    index, root = warc.write_archives(df, min_bytes=4)
    assert sorted((r.page_id, r.record_type) for r in warc.read_archives(index, root).collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_rows_equal_in_id_url_and_payload_have_one_response(spark):
    rows = [(1, "u", "ab"), (1, "u", "ab"), (1, "u", "ab"), (2, "u", "ab"), (1, "t", "ab"), (None, "u", None), (None, "u", ""), (5, "u", "c")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    want = [(1, 2, "response", None), *[(1, 2, "revisit", 1)] * 3, (2, 2, "revisit", 1), (None, 0, "response", None), (None, 0, "revisit", None), (5, 1, "response", None)]
    assert sorted(map(repr, ((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got))) == sorted(map(repr, want))


@pytest.mark.parametrize("kind", ["smallint", "decimal(20,0)", "string", "date"])
def test_ids_of_any_type(spark, kind):
    ids = {"date": ["2024-01-01", "2024-01-02"]}.get(kind, ["7", "11"])
    pages = spark.createDataFrame([(ids[0], "u", "ab"), (ids[1], "u", "ab"), (None, "u", "z")], "page_id string, url string, html string").withColumn("page_id", F.col("page_id").cast(kind))
    got = warc.round_trip(pages)
    assert got.schema["page_id"].dataType == pages.schema["page_id"].dataType
    least = min(ids) if kind in ("string", "date") else ids[0]
    assert {(r.p, r.record_type, r.r) for r in got.select(F.col("page_id").cast("string").alias("p"), "record_type", F.col("refers_to").cast("string").alias("r")).collect()} == {
        (least, "response", None), (next(x for x in ids if x != least), "revisit", least), (None, "response", None),
    }


def test_reads_are_coalesced():
    assert warc.coalesced([(0, 10), (10, 5), (20, 5), (10_000, 5)], gap=8, most=100) == [(0, 3, 0, 25), (3, 4, 10_000, 10_005)]
    assert warc.coalesced([(0, 60), (60, 60)], gap=8, most=100) == [(0, 1, 0, 60), (1, 2, 60, 120)]


def test_pipeline_stages(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, rows = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, data)
        assert out.columns == columns, name
        kept = out.collect()
        assert {tuple(r) for r in kept} <= {tuple(r) for r in rows.collect()}, name
        if name == "near_dedup":
            want = {r.component_id for r in simhash.near_duplicates(rows).collect()}
            assert sorted(r.doc_id for r in kept) == sorted(want)
        if name == "decontamination":
            bad = {r.doc_id for r in decontaminate.contamination(rows, spark.read.parquet(f"{data}/benchmark.parquet")).where("contaminated").collect()}
            assert {r.doc_id for r in rows.collect()} - {r.doc_id for r in kept} == bad
        rows = spark.createDataFrame(kept, docs.schema)
    want = sorted((r.doc_id, len(library.encode(r.text or "", add_bos=True, add_eos=True))) for r in rows.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, data).collect()) == want


def test_stages_with_any_column_name(spark):
    names = ["gone_id", "root", "keep_id", "keep_fp", "simhash_fp__", "fp", "g", "d", "c0", "text_hash", "component_id", "a.b", "row"]
    labels = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, quality int")
    rows = [(1, "The same text here.", "en"), (1, "the same text here.", "en"), (2, "another text of some words", "fr"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({name: F.lit("x") for name in names})
    kept = stages.one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    for f in (lambda d: stages.good_quality(d, labels), stages.known_language):
        assert f(docs).columns == docs.columns and f(docs).count() <= 4


def test_pipeline_stages_on_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "one two"), (2, "The same text here.")], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, quality int")
    for df in (odd, empty):
        for f in (lambda d: stages.good_quality(d, labels), stages.known_language, stages.one_of_each_group, lambda d: stages.uncontaminated(d, items)):
            assert f(df).columns == df.columns
    kept = stages.one_of_each_group(odd).collect()
    # Seven components: both rows of id 10 name one of their own.
    assert len(kept) == 7 and {r.doc_id for r in kept} == {r.component_id for r in simhash.near_duplicates(odd).collect()}
    gone = odd.count() - stages.uncontaminated(odd, items).count()
    assert gone == 4  # "one two", and three texts of the second item
