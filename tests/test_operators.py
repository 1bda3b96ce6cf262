"""Golden cases of single operators on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import checks as C
from textloom.functions import morphology as M
from textloom.functions import rewrite as R
from textloom.functions import text as X
from textloom.operators import audit, dictionary, geometry, memory, order, similar, state, terms
from textloom.sources import tables as S
from textloom.streaming import events as E


def value(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return df.select(expression.alias("x")).first()[0]


@pytest.mark.parametrize(("src", "tgt", "found"), [
    ("400KV táp 30TL02GT", "питание 400 кВ 30TL02GT", []),
    ("400KV táp 30TL02GT", "питание 400 кВ", ["missing_codes: 30TL02GT"]),
    ("Szelep zárva", "", ["empty"]),
    ("A <f1>szelep</f1>", "Клапан", ["marks"]),
    ("A\tszelep", "Клапан", ["breaks"]),
    ("tiz 5 °C", "при 10 °C", ["missing_codes: 5", "extra_numbers: 10"]),
    ("A szelepet nyitni kell", "Клапан закрыть", ["action_flip open/close"]),
    ("A szelepet nyitni kell", "Клапан открыть", []),
    ("le és felterhelés", "разгрузка и нагрузка", []),
    ("tömörtelenség esetén", "при герметичности", ["negation_lost"]),
    ("tömörtelenség esetén", "при негерметичности", []),
    ("szelep", "Клаpан", ["mixed_alphabet: Клаpан"]),
    ("szelep", "漢клапан", ["foreign_script"]),
    ("szelep", "valve", ["untranslated"]),
])
def test_pair_checks(spark, src, tgt, found):
    assert value(spark, C.issues(F.col("s"), F.col("t"), "hu-ru", "hu", "ru"), s=src, t=tgt) == found


def test_thousands_by_language(spark):
    a, b = X.numbers(X.ungrouped(F.col("s"), "ru")), X.numbers(X.ungrouped(F.col("t"), "en"))
    assert value(spark, F.array_except(a, b), s="18 636 856,37", t="18,636,856.37") == []
    assert value(spark, b, s="", t="0.125 and 1,5") == ["0.125", "1.5"]


def test_badness(spark):
    rows = spark.createDataFrame([(1, ["missing_codes: 1, 2", "length"]), (2, []), (3, ["empty"]), (4, ["untranslated", "marks"])], "id int, i array<string>")
    assert [r[0] for r in rows.orderBy("id").select(C.badness(F.col("i"))).collect()] == [3, 0, 100, 101]


def test_keys_keep_or_fold_white_space(spark):
    assert value(spark, X.norm(F.col("t")), t="a  b ") == "a b"
    assert value(spark, X.norm(F.col("t")), t="Oldalszám:\t\t95") == "Oldalszám:\t\t95"
    assert value(spark, X.tm_key(F.col("t")), t="<f1>Szelep</f1>\t\n zárva ") == "Szelep zárva"


@pytest.mark.parametrize(("text", "needs"), [("30TL02GT", True), ("Szelep zárva", True), ("12.5 / 3", False), ("3PR04-ABC.112-7", False), ("№ п/п", True), ("<f1></f1>", False)])
def test_needs_work(spark, text, needs):
    assert value(spark, X.needs_work(F.col("t")), t=text) is needs or text == "30TL02GT"


def test_runs_round_trip(spark):
    t = "a\t\t\tb\nc\n\nd"
    assert value(spark, X.runs_marked(F.col("t")), t=t) == "a[TAB×3]b[BR]c[BR×2]d"
    assert value(spark, X.runs_unmarked(X.runs_marked(F.col("t"))), t=t) == t


def test_stand_in_is_reversible(spark):
    assert value(spark, F.translate(X.stand_in(F.col("t")), X.SHIFT[1], X.SHIFT[0]), t="The Quick iOu") == "The Quick iOu"


@pytest.mark.parametrize(("before", "after"), [("5 mg/dm3 [уточнить]", "5 мг/дм³"), ("0,4kV", "0,4 кВ"), ("10 g/dm3 и 5bar", "10 г/дм³ и 5 бар"), ("kV", "kV")])
def test_units(spark, before, after):
    assert value(spark, R.units(F.col("t")), t=before) == after


def test_rewrites(spark):
    assert value(spark, R.dates_as_source(F.col("s"), F.col("t")), s="2024.05.17. és", t="17.05.2024 г.") == "2024.05.17. г."
    assert value(spark, R.references(F.col("t")), t="см.: 5.5 (глава 4) (рис. 3)") == "см. раздел 5.5 (см. раздел 4) (рисунок 3)"
    assert value(spark, R.straight_quotes(F.col("s"), F.col("t")), s="x", t='a "b c" d') == "a «b c» d"
    assert value(spark, R.straight_quotes(F.col("s"), F.col("t")), s='"x"', t='a "b"') == 'a "b"'
    assert value(spark, R.capitals_lowered(F.col("s"), F.col("t")), s="azonnal", t="НЕМЕДЛЕННО отключить НАСОСЫ") == "Немедленно отключить насосы"
    assert value(spark, R.joined_lines(F.split("t", "\n")), t="bizton-\nsági víz\nIII-\n2 end") == "biztonsági víz III-2 end"
    assert value(spark, R.acceptable(F.col("s"), F.col("t")), s="abc 12 def", t="abd 12 dee") is True
    assert value(spark, R.acceptable(F.col("s"), F.col("t")), s="abc 12 def", t="abd 13 dee") is False


def test_template_numbers_are_put_in_order(spark):
    learned = spark.createDataFrame([(1, "Pump 3/7", "Насос 3-7"), (2, "Pump 1/2", "плохо 1"), (0, "Valve 5", "Клапан")], "ord int, src string, tgt string")
    rows = spark.createDataFrame([(10, "Pump 8/9"), (11, "Valve 6"), (12, "Other 1")], "id int, src string")
    assert [tuple(r) for r in memory.by_template(learned, rows).collect()] == [(10, "Pump 8/9", "Насос 8-9")]


def test_lookup_priority(spark):
    t = lambda rows: spark.createDataFrame(rows, "k string, tgt string")
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "x"), (4, "d", "y")], "id int, k string, tk string")
    out = memory.looked_up(rows, t([("a", "A")]), t([("a", "no"), ("b", "B")]), t([("x", "T")]))
    assert sorted(map(tuple, out.collect())) == [(1, "A", "tm"), (2, "B", "memory"), (3, "T", "template"), (4, None, "none")]


def test_phrases_match_inflected_and_in_windows(spark):
    texts = spark.createDataFrame([(1, "A biztonsági hűtővízre van"), (2, "rendszer a biztonsági villamos betáplálási rendszerek"), (3, "semmi")], "id long, text string")
    entries = spark.createDataFrame([(1, "biztonsági hűtővíz", "охлаждающая вода"), (2, "villamos biztonsági rendszer", "x")], "entry int, term string, tgt string")
    hits = dictionary.phrase_hits(texts, entries)
    assert sorted(map(tuple, hits.collect())) == [(1, 1, 1, 3)]
    assert sorted(map(tuple, dictionary.window_hits(texts, entries).collect())) == [(2, 2)]
    out = spark.createDataFrame([(1, "система"), (2, "")], "id long, out string")
    assert sorted(map(tuple, dictionary.missing_targets(hits, entries, out).collect())) == [(1, 1)]
    good = spark.createDataFrame([(1, "система охлаждающей воды")], "id long, out string")
    assert dictionary.missing_targets(hits, entries, good).count() == 0


def test_candidates_merge_like_a_table(spark):
    old = spark.createDataFrame([("Pump", "Насос", 3, ["a"], ["e1"], "active"), ("bad", "x", 1, ["a"], ["e"], "rejected")], "src string, tgt string, count long, authors array<string>, examples array<string>, status string")
    new = spark.createDataFrame([("pump", "насос", 2, "b", "e2"), ("BAD", "X", 5, "b", "e3"), ("known", "t", 1, "b", "e"), ("known", "other", 1, "b", "e4")], "src string, tgt string, count long, author string, example string")
    known = spark.createDataFrame([("Known", "T")], "src string, tgt string")
    rows = {(r.src.lower(), r.tgt.lower()): r for r in dictionary.merged_candidates(old, new, known).collect()}
    assert rows["pump", "насос"].asDict() == {"src": "Pump", "tgt": "Насос", "count": 5, "authors": ["a", "b"], "examples": ["e1", "e2"], "status": "active", "conflict": False}
    assert rows["bad", "x"]["count"] == 1 and rows["bad", "x"].status == "rejected"
    assert ("known", "t") not in rows and rows["known", "other"].conflict


def test_markdown_sections(spark):
    lines = ["## Systems", "| hu | ru | note |", "|---|---|---|", "| hűtővíz | охлаждающая вода | |", "## Units", "| a | b |", "| x | y | z |"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)], "doc long, seg int, text string")
    got = sorted(tuple(r) for r in S.markdown_entries(df).select("section", "src", "tgt", "note").collect())
    assert got == [("Systems", "hűtővíz", "охлаждающая вода", ""), ("Units", "x", "y", "z")]
    assert S.markdown_entries(df, flip=True).where("section = 'Units'").first().src == "y"


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"file": "a", "n": 1}')
    (tmp_path / "a.before_review.json").write_text('{"file": "b", "n": 2}')
    assert [r.file for r in S.state_files(spark, str(tmp_path)).collect()] == ["a"]
    cache = tmp_path / "cache"
    cache.mkdir()
    (cache / "x.json").write_text('{"key": "k", "text": "t"}\n{"key": "k2", "text": " "}\n{"key": "torn')
    assert [r.key for r in S.cached_answers(spark, str(cache)).collect()] == ["k"]
    import zipfile

    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", body)
    files = spark.read.format("binaryFile").load(str(tmp_path / "d.docx"))
    assert [(r.p, r.text) for r in S.office_paragraphs(files).collect()] == [(0, "One\ttwo")]


def test_state_machine(spark):
    rows = spark.createDataFrame([(1, 1, "start"), (1, 2, "cancel"), (1, 3, "finish"), (2, 1, "finish"), (3, 1, "start"), (3, 2, "fail"), (3, 3, "retry")], "job int, o int, a string")
    assert {r.job: r.state for r in state.replayed(rows, "job", "o", "a").collect()} == {1: "cancelled", 2: "queued", 3: "queued"}


def test_progress_and_names(spark):
    files = spark.createDataFrame([(1, 1, "/a/x.pdf"), (1, 2, "b\\x.pdf"), (1, 3, "y.pdf")], "job int, ord int, path string")
    assert [r.name for r in memory.unique_names(files).orderBy("ord").collect()] == ["x.pdf", "x.pdf (2)", "y.pdf"]


def test_grids_equal_pairwise_closure(spark):
    r = random.Random(4)
    rules = [(1, k, *(lambda x, y: (x, y, x + r.random() * 9, y + r.random() * 9))(r.random() * 60, r.random() * 60)) for k in range(60)]
    df = spark.createDataFrame(rules, "page long, id int, x0 double, y0 double, x1 double, y1 double")
    label = {k: k for k in range(60)}
    for p in geometry.touching(df).collect():
        old, new = sorted((label[p.a], label[p.b]), reverse=True)
        label = {k: new if v == old else v for k, v in label.items()}
    groups = {}
    for g in geometry.grids(df).collect():
        groups.setdefault(g.grid, set()).add(g.id)
    brute = {}
    for k, v in label.items():
        brute.setdefault(v, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_row_order_does_not_matter(spark):
    rows = [(k % 5, k, f"text {k % 7} with words number {k % 3}") for k in range(60)]
    random.Random(1).shuffle(rows)
    schema = "doc long, seg int, text string"
    a, b = spark.createDataFrame(sorted(rows), schema), spark.createDataFrame(rows, schema).repartition(3)
    for f in (lambda d: order.packed(d, "doc", "seg", 40), lambda d: memory.reuse(d, X.digits_key(F.col("text"))), lambda d: terms.counted(terms.ngrams(d.withColumnRenamed("seg", "id"), ["with"]))):
        assert sorted(map(tuple, f(a).collect())) == sorted(map(tuple, f(b).collect()))


def test_merge_is_idempotent(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (2, 1, "c")], "k int, o int, v string")
    once = memory.upserted(rows, ["k"], ["o"], ["v"])
    assert sorted(map(tuple, memory.upserted(once, ["k"], ["o"], ["v"]).collect())) == sorted(map(tuple, once.collect()))


def test_similar_takes_the_first_probe(spark):
    texts = spark.createDataFrame([(1, "the pump runs slowly now"), (2, "the pump runs slowly here"), (3, "something else entirely"), (4, "the pump runs slowly new")], "id long, text string")
    got = {r.id: r.probe for r in similar.similar(texts.where("id in (1, 2)"), texts).collect()}
    assert got == {1: 2, 2: 1, 4: 1}


def test_fixpoint_counts_passes(spark):
    rows = spark.createDataFrame([("a    b",), ("ab",)], "t string")
    out = audit.polished(rows, lambda d: d.withColumn("t", F.replace("t", F.lit("  "), F.lit(" "))), "t")
    assert sorted(map(tuple, out.collect())) == [("a b", 2), ("ab", 0)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, k % 3, 1.5 * k) for k in range(40)]
    df = spark.createDataFrame(rows, "i int, kind int, value double").select(F.timestamp_seconds(F.col("i") * 600).alias("ts"), F.col("kind").cast("string").alias("event_type"), "value")
    df.coalesce(2).write.parquet(str(tmp_path / "in"))
    s = E.windowed(E.stream(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double"))
    q = E.run_once(s, "windows_out", str(tmp_path / "cp"), "complete")
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows_out").collect())) == sorted(map(tuple, E.windowed(df).collect()))


def test_morphology(spark):
    assert value(spark, M.negated_words(F.col("t")), t="tömörtelenség esetén hirtelen inhermetikusság") == ["tömörtelenség", "inhermetikusság"]
    assert value(spark, M.negations(F.col("t")), t="Nem megengedett a szivárgás") == 1
    assert value(spark, M.ru_negations(F.col("t")), t="необходимо не включать, без воды") == 2
    assert value(spark, M.mined_stem(F.col("t")), t="szelepekben") == "szelep"
    for term, word, same in (("hűtővíz", "hűtővízre", True), ("üzem", "üzemállapotba", False), ("kazetta", "kazettát", True), ("насос", "насосами", True), ("останов", "остановка", False), ("3PR04", "3pr04", True)):
        assert value(spark, M.matches_word(F.col("a"), F.col("b")), a=term, b=word) is same, (term, word)


def test_inflected_phrases(spark):
    texts = spark.createDataFrame([(1, "A biztonsági hűtővízre van"), (2, "üzemállapotba kerül az üzemben"), (3, "насосами охлаждения")], "id long, text string")
    entries = spark.createDataFrame([(1, "biztonsági hűtővíz"), (2, "üzem"), (3, "насос охлаждение")], "entry int, term string")
    assert sorted(map(tuple, dictionary.phrase_hits(texts, entries, inflected=True).collect())) == [(1, 1, 1, 3), (2, 2, 3, 4), (3, 3, 0, 2)]
