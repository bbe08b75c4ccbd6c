"""Ids of any kind, many null ids, many rows of one id, and columns with clashing names, for all operators and stages."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lodeframe.llm import chat, langid, licenses, mixing, secrets, toxicity
from lodeframe.llm.decontaminate import contaminated
from lodeframe.llm.scratch import is_held_out
from lodeframe.llm.simhash import simhash_groups
from lodeframe.llm.substring import substring_dedup
from lodeframe.llm.topk import top_k

WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
SENTENCES = {"en": "the quick brown fox jumps over the lazy dog and runs away from the house", "de": "der schnelle braune fuchs springt über den faulen hund und läuft aus dem haus"}


def _rows():
    rows = [(i, f"{SENTENCES['en' if i % 2 else 'de']} {' '.join(WORDS[(i + k) % 16] for k in range(15))}", "en" if i % 2 else "de", f"s{i % 3}", 9) for i in range(60)]
    rows += [(None, SENTENCES["en"], "en", None, None), (None, None, None, None, None)] * 40  # many rows without an id
    rows += [(7, SENTENCES["de"], "de", "s1", 5)] * 60  # one id repeated
    return rows + [(100, None, "en", "s0", 0), (101, "", None, "s0", 0), (102, "x " * 60_000, "en", "s0", 120_000)]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns named as those that the operators return or use inside."""
    extra = ", ".join(f"`{c}` string" for c in ("fp", "row", "h", "key", "score", "topic", "spans", "_lodeframe_key", "_row"))
    return spark.createDataFrame([(*r, *("x",) * 9) for r in _rows()], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")


def bench(spark):
    return spark.createDataFrame([(1, " ".join(WORDS))], "item_id bigint, text string")


def labels(spark):
    return spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "op1": lambda s, d: langid.predict(d, langid.fit(d, ~is_held_out("doc_id")), is_held_out("doc_id")),
    "op2": lambda s, d: simhash_groups(d),
    "op3": lambda s, d: contaminated(d, bench(s)),
    "op4": lambda s, d: secrets.scan(d),
    "op6": lambda s, d: licenses.scan(d),
    "op8": lambda s, d: mixing.mixed(d),
    "op9": lambda s, d: substring_dedup(d),
    "op10": lambda s, d: toxicity.predict(d, toxicity.fit(d, labels(s), ~is_held_out("doc_id")), is_held_out("doc_id")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator(spark, docs, name):
    got = OPERATORS[name](spark, docs)
    if name in ("op3", "op6"):
        assert all(r.doc_id is not None for r in got.collect())
    else:
        ids = [r.doc_id for r in got.select("doc_id").collect()]
        assert sorted(ids, key=str) == sorted((r[0] for r in _rows()), key=str)
    assert OPERATORS[name](spark, docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op8", "op10"])
def test_string_ids(spark, docs, name):
    named = docs.withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    plain = {str(r) for r in OPERATORS[name](spark, docs).where("doc_id < 50").select("doc_id").distinct().collect()}
    if name == "op10":
        got = toxicity.predict(named, toxicity.fit(named, labels(spark).withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))), ~is_held_out("doc_id")), is_held_out("doc_id"))
    else:
        got = OPERATORS[name](spark, named)
    assert got.schema["doc_id"].dataType.simpleString() == "string"
    rows = got.where("doc_id IS NOT NULL").collect()
    assert all(r.doc_id.startswith("doc-") for r in rows)
    assert len({r.doc_id for r in rows if int(r.doc_id[4:]) < 50}) == len(plain)
    if name == "op2":
        assert all(r.component_id.startswith("doc-") and r.component_id <= r.doc_id for r in rows)


def test_ids_that_must_be_integers(spark, docs):
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    with pytest.raises(TypeError):
        substring_dedup(named)
    with pytest.raises(TypeError):
        top_k(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"), F.lit(True))


@pytest.mark.parametrize("place", range(len(P.STAGES)))
def test_stage(spark, docs, tmp_path, place):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = P.STAGES[place]
    got = stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    have = {tuple(r)[:5] for r in got.collect()}
    if name != "secrets":
        assert have <= {tuple(r)[:5] for r in docs.collect()}
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    if name == "near-duplicates":
        kept = [r for r in got.collect() if r.doc_id == 7]
        texts = [r.text for r in docs.where("doc_id = 7").collect()]
        assert len(kept) <= 1 and all(r.text == min(texts) for r in kept)  # of different texts under one id, always the same
        assert got.where("doc_id IS NULL").count() == 80


def test_many_turns_without_a_conversation(spark):
    turns = spark.createDataFrame([(None, i % 4, "user", f"t{i}") for i in range(200)] + [(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id bigint, turn bigint, role string, text string")
    got = chat.conversations(turns).collect()
    assert len(got) == 201 and [r.valid for r in got if r.conv_id == 1] == [True]
    assert sorted(r.formatted for r in got if r.conv_id is None) == sorted(f"<s>[INST]t{i}[/INST]</s>" for i in range(200))


def test_rows_without_an_id_keep_their_words(spark):
    text = " ".join(WORDS)
    df = spark.createDataFrame([(None, text)] * 50 + [(1, text), (2, text)], "doc_id bigint, text string")
    got = substring_dedup(df).collect()
    whole = hashlib.sha256(text.encode()).hexdigest()
    assert len(got) == 52 and all((r.n_removed, r.kept_sha256) == (0, whole) for r in got if r.doc_id != 2)
    assert [r.n_removed for r in got if r.doc_id == 2] == [16]


def test_one_id_does_not_fill_the_sample(spark):
    """A million rows of an id count as one of its language's ids, and are learnt from as one."""
    rows = [(i, SENTENCES["en"] + f" {WORDS[i % 16]}", "en") for i in range(40)] + [(i + 100, SENTENCES["de"] + f" {WORDS[i % 16]}", "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    more = spark.range(20_000).select(F.lit(300).cast("bigint").alias("doc_id"), F.lit(SENTENCES["de"]).alias("text"), F.lit("en").alias("lang"))
    m = langid.fit(docs.unionByName(more), F.lit(True), each=20)
    got = langid.predict(docs, m, F.lit(False)).join(docs.select(F.col("doc_id").alias("i"), "lang"), F.col("doc_id") == F.col("i")).collect()
    assert sum(r.lang_pred == r.lang for r in got if r.lang == "en") >= 36


def test_more_languages_than_the_sample(spark):
    docs = spark.createDataFrame([(i, f"w{i} {SENTENCES['en']}", f"l{i % 7}") for i in range(70)], "doc_id bigint, text string, lang string")
    m = langid.fit(docs, F.lit(True), sample=5)
    assert len(set(m.langs)) == 5
