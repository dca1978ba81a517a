import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from tablecraft.llm import mixing, simhash
from tablecraft.llm.text import ROW, TEXT_CODEC, with_row_keys
from tablecraft.session import materialize


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = [docs]
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, small), "stage")
        kept.append(docs)
    return kept


def test_stages(stages):
    assert [name for name, _ in pipeline.STAGES] == [
        "quality rules", "line dedup", "simhash near-dedup",
        "mixing sources to target weights", "best-fit packing",
    ]
    for docs in stages[:-1]:
        assert docs.columns == stages[0].columns
    sizes = [docs.count() for docs in stages]
    assert sizes[1] == sizes[2] and sizes[1] < sizes[0] and sizes[3] < sizes[2]
    assert stages[-1].select("doc_id").distinct().count() == stages[-2].select("doc_id").distinct().count()


def test_run_equals_the_stages(spark, small, stages):
    columns = ["doc_id", "piece", "length", "ids_crc32"]
    again = pipeline.run(spark, small).select(columns)
    assert again.exceptAll(stages[-1].select(columns)).count() == 0
    assert stages[-1].select(columns).exceptAll(again).count() == 0


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert found.keys() == sets.keys()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if sets[a] == sets[b] or shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                assert found[a] == found[b]
    for a in ids:
        if found[a] != a:
            partners = [b for b in ids if found[b] == found[a] and b != a]
            assert any(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in partners)


def test_near_copies_of_edge_cases(edge_docs, no_docs):
    found = {}
    for r in simhash.near_duplicates(edge_docs).collect():
        found.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert found[1] == found[2] == {1} and found[3] == found[4] == found[5] == {3}
    assert None not in found and found[6] == {6}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_stages_handle_edge_cases(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, stage in pipeline.STAGES:
            result = stage(spark, docs, "")
            assert result.count() >= 0
            if stage is not pipeline.STAGES[-1][1]:
                assert result.columns == docs.columns


UNCLEAR_IDS = [
    (7, "Entirely different words stand in the first of the two texts here."),
    (7, "Nothing that the other text says is said again by this second one."),
    (None, "A row without an id has a text that nobody else in the table has."),
    (None, "Another row without an id has something of its own to tell as well."),
    (None, "A  row without an id has a text that nobody else in the TABLE has."),
    (3, "Only this row has both an id and words that are found nowhere else."),
    (3, "Only this row has both an id and words that are found nowhere else."),
    (None, "Only this row has both an id and words that are found nowhere else."),
]


@pytest.fixture(scope="module")
def unclear_docs(spark):
    """Ids that are null or shared, with equal and different texts."""
    rows = [(i, text, "en", "one", len(text)) for i, text in UNCLEAR_IDS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    )


def test_near_copies_are_judged_by_text_whatever_the_id(spark, unclear_docs):
    kept = pipeline.drop_near_copies(spark, unclear_docs, "").collect()
    found = sorted((r["doc_id"], " ".join(r["text"].lower().split())) for r in kept if r["doc_id"])
    nulls = sorted(" ".join(r["text"].lower().split()) for r in kept if r["doc_id"] is None)
    assert found == sorted((i, UNCLEAR_IDS[n][1].lower()) for n, i in ((0, 7), (1, 7), (5, 3)))
    assert nulls == sorted(UNCLEAR_IDS[n][1].lower() for n in (2, 3))


def test_kept_rows_agree_with_the_groups(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    smallest = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(smallest)


def test_the_mix_loses_no_row_for_its_id(spark):
    texts = [f"text {n} " + "word " * (n % 5) for n in range(40)]
    rows = [(None if n < 20 else n % 4, t, f"s{n % 2}") for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = mixing.mix(docs).agg(F.sum("copies"), F.sum("taken")).first()
    mixed = pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns and mixed.count() == copies[0]
    words = sum(len(r["text"].split()) for r in mixed.collect())
    assert words == copies[1]
    assert mixed.groupBy(*docs.columns).count().where("count > 2").count() == 0


def test_kept_copies_of_texts_are_packed_tightly(spark, small, tmp_path):
    """What a stage keeps of the texts takes less disk than with the default codec."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plain, kept = (tmp_path / name for name in ("plain", "kept"))
    materialize(docs, "texts", str(plain))
    found = with_row_keys(docs, "texts")
    materialize(found.drop(ROW), "texts", str(kept), TEXT_CODEC)
    assert sorted(map(str, found.drop(ROW).collect())) == sorted(map(str, docs.collect()))
    assert all(".zstd." in path for path in found.inputFiles())
    plain, kept = (sum(f.stat().st_size for f in at.glob("*.parquet")) for at in (plain, kept))
    assert kept < 0.8 * plain
