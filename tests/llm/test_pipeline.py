"""The pipeline's stages on the small tables: each keeps what it should, and run() equals the chain."""

import random
from itertools import combinations
from pathlib import Path

import corpus_pipeline
import pytest
import xxhash

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        if k < 4:
            assert docs.columns == columns
        else:
            assert now == ids
        ids = now
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, docs.collect()))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, part string, fp string, step long, gone_id long, mix_source string, w long"
CLASH = ("h", "part", "fp", 1, 1, "x", 2)
STAGE = dict(corpus_pipeline.STAGES)


def told(rng, n=60, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Texts of two alphabets, copies and near copies, repeated lines, nulls in every column, repeated rows, a very long text, a leak."""
    rng = random.Random(3)
    out = [(k, "\n".join([told(rng, letters="abcdefghij" if k % 2 else "klmnopqrst") for _ in range(3)]), "xx" if k % 2 else "yy", f"s{k % 3}") for k in range(60)]
    out += [(100 + k, out[k][1], out[k][2], "s0") for k in range(4)]
    words = out[7][1].split(" ")
    out += [(110, " ".join([*words[:-1], "changed"]), "xx", "s1"), (111, out[9][1].split("\n")[0] + "\n" + told(rng), "xx", "s1")]
    out += [(120, None, "xx", "s0"), (121, "", "xx", None), (122, " \n\t", None, "s0"), (123, "12 34 ?!", "xx", "s0"), (None, told(rng), "xx", "s2"), (None, None, None, None), (124, told(rng, 40_000), "xx", "s1")]
    return out + [(5, out[5][1], out[5][2], out[5][3])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if i == 3 else len(t or ""), *CLASH) for i, t, lang, s in rows], SCHEMA)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, docs, name):
    got = STAGE[name](spark, docs.limit(0), SF)
    assert got.collect() == [] and got.columns[: len(docs.columns)] == docs.columns


def test_language_stage(spark, docs, rows):
    got = STAGE["language"](spark, docs, SF)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert all(t and any(c.isalpha() for c in t) for _, t in kept) and {r.part for r in got.collect()} == {"part"}
    clean = [(i, t) for i, t, _, _ in rows if t and any(c.isalpha() for c in t)]
    assert len(kept) >= 0.95 * len(clean) and set(kept) <= set(clean) and kept.count(rows[5][:2]) in (0, 2)


def test_line_stage(spark, docs, rows):
    """Against the rule, by plain comparison: of equal lines of different documents the first stays."""
    got = STAGE["lines"](spark, docs, SF)
    assert got.columns == docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in got.collect() if r.doc_id is not None}
    assert all(n == len(t) for i, (t, n) in texts.items() if t is not None) and texts[120] == (None, None) and texts[121][0] == "" and texts[122][0] == " \n\t"
    assert not {100, 101, 102, 103} & set(texts)  # nothing is left of a copy
    assert texts[111][0] == rows[[r[0] for r in rows].index(111)][1].split("\n")[1] and texts[124][0] == rows[[r[0] for r in rows].index(124)][1]
    assert all(texts[k][0] == rows[k][1] for k in range(60)) and sum(r.doc_id is None for r in got.collect()) == 2


def prints(text):
    words = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_stage(spark, docs, rows):
    """Against all pairs: of each group of linked documents the smallest doc_id stays."""
    got = STAGE["simhash"](spark, docs, SF)
    assert got.columns == docs.columns
    fp = {i: prints(t) for i, t, _, _ in rows if i is not None}
    group = {i: i for i in fp}
    for _ in fp:  # the smallest id spreads over the links
        for a, b in combinations(sorted(fp), 2):
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                group[a] = group[b] = min(group[a], group[b])
    want = sorted(i for i, _, _, _ in rows if i is not None and group[i] == i)
    kept = [r.doc_id for r in got.collect()]
    assert sorted(i for i in kept if i is not None) == want and kept.count(None) == 2 and kept.count(5) == 2


def test_decontamination_stage(spark, docs, rows, tmp_path):
    item = " ".join(rows[11][1].split("\n")[1].split()[5:30])
    spark.createDataFrame([(1, item), (1, item), (2, None), (None, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = STAGE["decontamination"](spark, docs, str(tmp_path))
    left = [r.doc_id for r in got.collect()]
    assert got.columns == docs.columns and sorted(map(str, left)) == sorted(str(r[0]) for r in rows if r[0] != 11)


def test_mixing_stage(spark, docs, rows):
    got = STAGE["mixing"](spark, docs, SF).collect()
    first = [(r.doc_id, r.text) for r in got if r.mix_epoch == 0]
    assert sorted(map(str, first)) == sorted(str(r[:2]) for r in rows) and len({r.mix_position for r in got}) == len(got)


def test_whole_run(spark, docs, rows, tmp_path):
    """run() over the awkward table, and over an empty one; a run that fails leaves no folder."""
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert got.columns == [*docs.columns, "mix_epoch", "mix_slot", "mix_position"]
    ids = {r.doc_id for r in got.collect()}
    assert ids <= {r[0] for r in rows} and not ids & {100, 101, 102, 103, 120, 121, 122, 123} and len(ids) > 50
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = {p.name for p in Path(folder).glob("pipeline-*")}
    docs.write.parquet(f"{tmp_path}/c/documents.parquet")
    with pytest.raises(Exception, match="benchmark"):
        corpus_pipeline.run(spark, f"{tmp_path}/c")
    assert {p.name for p in Path(folder).glob("pipeline-*")} == before
