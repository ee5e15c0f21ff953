"""The pipeline's stages on a small folder of tables."""

import random
import zlib

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import brute_classes, brute_repeats, hf


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    vocab = {"en": "the river stone was blue and walked away from".split(), "de": "der fluss stein war blau und ging weg von".split()}

    def text(lang, n=90):
        return " ".join(rng.choice(vocab[lang]) + str(rng.choice(["", "ly", "en", "s", "ing"])) for _ in range(n)) + "."

    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        t = text(lang) if i % 5 else " ".join("BUY!! $$$" for _ in range(40))
        rows.append((i, t, lang, "s", len(t)))
    near = rows[1][1].split()
    near[4] = "other"
    rows.append((500, " ".join(near), "en", "s", 1))
    rows.append((501, rows[7][1], "en", "s", 1))
    rows.append((502, text("en", 40) + " " + rows[11][1][:200] + " " + text("en", 40), "en", "s", 1))
    rows.append((503, None, None, None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def staged(spark, folder):
    """The rows that each stage reads and returns, applied one by one."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, folder)
        if name != "pack":
            assert made.columns == columns
        rows = made.collect()
        out[name] = ([(r.doc_id, r.text) for r in docs.collect()], rows)
        docs = spark.createDataFrame(rows, made.schema)
    return out


def test_stages(staged):
    kept = {name: {r.doc_id: r.text for r in rows} for name, (_, rows) in staged.items() if name != "pack"}
    assert {i for i in range(120) if i % 5} <= set(kept["quality"])
    assert not {i for i in range(0, 120, 5)} & set(kept["quality"])
    assert 503 not in kept["language"] and {i for i in range(120) if i % 5} <= set(kept["language"])
    assert {500, 501} & set(kept["near_duplicates"]) == set() and 502 in kept["near_duplicates"]
    assert len(kept["repeats"][502]) <= len(kept["near_duplicates"][502]) - 200


def test_near_duplicates_keeps_one_of_each_class(staged):
    read, rows = staged["near_duplicates"]
    classes = brute_classes(read, pipeline.PERCENT, pipeline.WIDTH)
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((i, t) for i, t in read if classes[i][1] == i)


def test_repeats_cuts_what_brute_force_cuts(staged):
    read, rows = staged["repeats"]
    expected = {i: (kept.decode(), n) for i, (n, gone, _, kept) in brute_repeats(read).items() if gone < n or n == 0}
    assert {r.doc_id: r.text for r in rows} == {i: t for i, (t, _) in expected.items()}
    assert all(r.n_chars == len(r.text) for r in rows)


def test_pack_holds_every_id_once(staged):
    read, rows = staged["pack"]
    encode = hf("byte_bpe_50k.json")
    ids = {i: np.array([*encode(t), 1], "<u4") for i, t in read}
    ends = dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == ends[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        ends[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert ends == {i: len(x) for i, x in ids.items()}


def test_run_equals_stages(spark, folder, staged):
    ran = pipeline.run(spark, folder).collect()
    whole = lambda rows: sorted((i, n, sum(r.length for r in rows if r.doc_id == i)) for i, n in {(r.doc_id, r.doc_tokens) for r in rows})
    assert whole(ran) == whole(staged["pack"][1])
