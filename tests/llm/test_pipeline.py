"""The pipeline against plain versions of its stages, on a fixture small enough to compare every pair."""

import random

import corpus_pipeline
from evscreen.llm import decontaminate, langid, lines, mixing, simhash

from . import brute

#: Letters that tell three made-up languages apart.
SOUNDS = {"xx": ["ba", "ra", "na", "ka"], "yy": ["lo", "so", "mo", "to"], "zz": ["üh", "öl", "äß", "ür"]}


def word(rng, lang):
    return "".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(2, 7)))


def fixture(tmp_path, spark):
    rng = random.Random(12)
    items = [(n, " ".join(word(rng, "xx") for _ in range(20))) for n in range(4)]
    rows = []
    for i in range(120):
        lang = "xx" if i % 10 == 3 else rng.choice(list(SOUNDS))  # as the items
        text = [" ".join(word(rng, lang) for _ in range(rng.randrange(6, 30))) for _ in range(rng.randrange(1, 5))]
        if i % 9 == 0:
            text.append({"xx": "bara naka kara baba", "yy": "loso moto solo toto", "zz": "ühöl äßür ürüh ölöl"}[lang])
        if i % 10 == 3:
            text[0] = items[rng.randrange(4)][1]
        if i % 8 == 5:  # lines of ten words, of which the next document but seven changes one: too many for line dedup
            text = [" ".join(f"{word(rng, lang)}{n}" for n in range(10)) for _ in range(8)]
        if i % 8 == 4 and i > 8:
            text, lang = [" ".join([*x.split(" ")[:-1], word(rng, "xx")]) for x in rows[i - 7][1].split("\n")[:8]], rows[i - 7][2]
        rows.append((i, "\n".join(text), lang, f"src{rng.randrange(4)}", len("\n".join(text))))
    rows += [(200, "1234 5678", "xx", "src0", 9), (201, None, "xx", "src0", None), (202, "", "xx", "src0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, items


def test_stages_and_run(spark, tmp_path):
    rows, items = fixture(tmp_path, spark)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    source = {r[0]: r[3] for r in rows}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == (columns if n < 4 else [*columns, "copy_no"]), name
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept.append(docs.collect())

    spoken = [(r["doc_id"], r["text"]) for r in kept[0]]
    assert {r[0] for r in rows} - {i for i, _ in spoken} == {200, 201, 202}
    deduplicated = brute.deduplicated(sorted(spoken), lines.THRESHOLD)
    assert {(r["doc_id"], r["text"]) for r in kept[1]} == set(deduplicated)
    assert all(r["n_chars"] == len(r["text"]) for r in kept[1]) and len(deduplicated) < len(spoken) or any(a != b for a, b in zip(sorted(spoken), deduplicated))
    gone = brute.copies(sorted(deduplicated), simhash.BLOCKS * simhash.BLOCK_BITS, simhash.MAX_DISTANCE, lambda x, y: brute.meet(x, y, simhash.BLOCKS, simhash.BLOCK_BITS))
    single = [x for x in deduplicated if x[0] not in gone]
    assert gone and {r["doc_id"] for r in kept[2]} == {i for i, _ in single}
    bad = {i for i, _ in brute.leaked(single, items, decontaminate.MIN_SCORE)}
    clean = [x for x in single if x[0] not in bad]
    assert bad and {r["doc_id"] for r in kept[3]} == {i for i, _ in clean}
    want = brute.mixed([(i, source[i], t) for i, t in clean], *brute.mixing_defaults())
    got = {}
    for r in kept[4]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {i: n for i, n in want.items() if n}
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, kept[4]))


def test_near_dedup_on_its_own_input(spark, tmp_path):
    """Of what every pair gives, whether it meets in a block or not, the stage drops 0.9 at least and nothing else."""
    fixture(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, str(tmp_path))
    docs.write.parquet(f"{tmp_path}/own")
    docs = spark.read.parquet(f"{tmp_path}/own")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = brute.copies(sorted(texts.items()), simhash.BLOCKS * simhash.BLOCK_BITS, simhash.MAX_DISTANCE)
    got = set(texts) - {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()}
    assert want and got <= set(want) and len(got) >= 0.9 * len(want)


def test_stages_begin_with_collected_garbage(spark, tmp_path):
    fixture(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    collectors = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    before = sum(c.getCollectionCount() for c in collectors)
    corpus_pipeline.source_mix(spark, docs, str(tmp_path))  # other stages also collect the driver's garbage, which is the same process here
    assert sum(c.getCollectionCount() for c in collectors) > before


def test_stages_take_an_empty_table(spark, tmp_path):
    fixture(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).isEmpty()


def test_defaults_are_those_of_the_operators():
    assert 0 < langid.MIN_CONFIDENCE < 1 and mixing.DEFAULT_WEIGHT > 0 and corpus_pipeline.ORACLE_SQL is None
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "source mix"]
