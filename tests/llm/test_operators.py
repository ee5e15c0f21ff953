"""Operators against brute force, on texts with nulls, empties, repeats, ties and long runs."""

import hashlib
import random
import re
import tracemalloc
import weakref
from collections import Counter, namedtuple
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tallyspark.llm.queries")

from tallyspark.llm import bpe_fst, chat_format, common, fingerprints, language_id, ngram_join, packing, quality_pu, quality_rules, suffix_dedup, token_binary, units
from tallyspark.llm.queries import _PATTERN, _path

EDGES = [None, "", " ", "a", "A b", "a b c", "a  b\n\n\tc ", "é ÀÉ ΑΣ Σ İ", "日本語 テキスト", "a\x1cb \x85c", "don't we'll 'S", "<|endoftext|> 12", "x" * 300, "word " * 400]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "et", "und", "Stone", "river", "über", "casa", "blue", "run.", "x!", "###", "|"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(n)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    for t in texts[:12]:
        w = t.split()
        texts.append(t)
        if len(w) > 5:
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
        texts.append(t[:40] + passage + "\n" + t[40:80])
    texts += EDGES + EDGES[-3:]
    rng.shuffle(texts)
    return [(3 * i - 20, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names clash with those that operators make."""
    data = [(i, t, 1, "x", "y") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, n long, h string, id string").repartition(5)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_quality_rules(docs, rows, nothing):
    got = {r.doc_id: r for r in quality_rules.clean(docs).collect()}
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality_rules.clean(nothing).count() == 0


def test_quality_rules_lines(spark):
    clean = "The quiet river, which ran past the old stone house, was blue in the morning light and grey at night.\n"
    nav = "Home | About | Contact | News | Login | Search | Help | Map | Shop | Cart | Blog | Jobs\n"
    shout = "BUY!! NOW!! THIS!! IS!! A!! DEAL!! FOR!! YOU!! AND!! ALL!! OF!! THEM!!\n"
    df = spark.createDataFrame([(1, clean), (2, clean + nav), (3, nav + nav.lower() + shout + "Fine, this stays.")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.clean(df).collect()}
    assert got[1].kept and got[1].n_failed_lines == 0
    assert got[2].n_failed_lines == 1 and got[2].clean_text == clean.strip("\n")
    assert not got[3].kept


def test_columns_named_like_helpers_pass(spark):
    names = ("_words", "_lines", "_bucket", "_copy", "_r", "__r")
    df = spark.createDataFrame([(i, f"text {i}", *(f"{n}{i}" for n in names)) for i in range(5)], ["doc_id", "text", *names])
    for out in (quality_rules.clean(df), fingerprints.with_next(df, {"after": F.col("text")})):
        assert {(r.doc_id, *(r[n] for n in names)) for r in out.collect()} == {(i, *(f"{n}{i}" for n in names)) for i in range(5)}
    assert {r.doc_id: r.after for r in out.collect()} == {i: f"text {(i - 1) % 5}" for i in range(5)}


def brute_classes(rows, percent, width):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("percent", "width", "deletions"), [(90, 3, 0), (80, 5, 0), (90, 3, 2)])
def test_ngram_join(docs, rows, nothing, monkeypatch, percent, width, deletions):
    if deletions:
        def allocate(self, n_sets):
            self.m1 = min(deletions, (self.differ + 1) // 2)
            self.m = self.differ + 1 - self.m1

        monkeypatch.setattr(ngram_join.Band, "allocate", allocate)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicate_classes(docs, percent, width).collect()}
    assert got == brute_classes(rows, percent, width)
    if not deletions:
        assert ngram_join.near_duplicate_classes(nothing, percent, width).count() == 0


def test_ngram_join_null_and_repeated_ids(spark):
    t = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (7, t + " z"), (9, None)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.near_duplicate_classes(df, 90, 3).collect()), key=str)
    assert got == sorted([(None, 38, None), (5, 38, 5), (5, 38, 5), (7, 39, 5), (9, 0, 9)], key=str)


def test_allocation_uses_deletions_where_chance_meetings_cost_more():
    band = ngram_join.Band(0, 90, 100, 90)
    band.allocate(1000)
    assert band.m1 == 0
    small = ngram_join.Band(0, 6, 7, 80)
    small.allocate(10**6)
    assert small.m1 > 0
    for b in (band, small):
        assert b.m + b.m1 == b.differ + b.spare


@pytest.mark.parametrize(("m1", "spare"), [(0, 1), (0, 4), (3, 1), (3, 5)])
def test_linked_sets_share_a_signature(m1, spare):
    rng = np.random.default_rng(m1 + spare)
    for size in (12, 30, 80):
        band = ngram_join.Band(3, size * 4 // 5, size, 80)
        band.spare, band.m1 = spare, min(m1, (band.differ + spare) // 2)
        band.m = band.differ + spare - band.m1
        for _ in range(200):
            universe = rng.integers(0, 1 << 63, 2 * size).astype(np.uint64)
            a, gone, new = universe[:size], *rng.integers(0, band.differ + 1, 2)
            gone, new = min(gone, band.differ), min(new, band.differ - min(gone, band.differ))
            b = np.concatenate([a[gone:], universe[size : size + new]])
            sigs = [set(ngram_join.signatures(np.sort(x), band).tolist()) for x in (a, b)]
            assert sigs[0] & sigs[1]


def hf(name):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(_path(name))
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def test_token_files(docs, rows, nothing, monkeypatch):
    monkeypatch.setattr(token_binary, "PART_BYTES", 4000)
    monkeypatch.setattr(token_binary, "BLOCK_IDS", 300)
    encode = hf("word_bpe_49k.json")
    got = sorted(token_binary.round_trip(docs, _path("word_bpe_49k.json")).collect())
    start = 0
    assert len(got) == len(rows)
    for (i, t), r in zip(sorted(rows, key=lambda x: x[0]), got):
        ids = [*encode(t), 2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    assert token_binary.round_trip(nothing, _path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 5000])
def test_huffman_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.pareto(0.4, n).astype(np.int64), 40000)
    found, counts = np.unique(ids, return_counts=True)
    lengths = token_binary.code_lengths(dict(zip(found.tolist(), counts.tolist())))
    assert max(lengths.values()) <= token_binary.MAX_BITS
    assert sum(2.0**-b for b in lengths.values()) <= 1
    coder = token_binary.Coder(lengths)
    checkpoints, payload = coder.encode(ids)
    assert (coder.decode(payload, checkpoints, n) == ids).all()


def test_code_lengths_are_limited():
    lengths = token_binary.code_lengths({i: 2**i for i in range(30)}, max_bits=6)
    assert max(lengths.values()) == 6 and sum(2.0**-b for b in lengths.values()) == 1


def test_chat_format(spark):
    def conv(i, *said):
        return [(i, k, "user" if k % 2 == 0 else "assistant", s) for k, s in enumerate(said)]

    data = conv(1, "hi", "yes") + conv(2, "hi") + conv(3, "hi", "yes", "more") + conv(4, "hi", "no") + conv(5, "hi", "no") + conv(6, None, "") + [(None, 0, "user", "x")]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_chats(turns).collect()}
    assert set(got) == {3, 4, 6} and got[4].n_copies == 2
    assert got[3].chat == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_fingerprints(docs, rows, nothing, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 20)
    got = {r.doc_id: r for r in fingerprints.edited(docs).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    by_text = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)]
        third = len(t) // 3
        edit = t[: len(t) - third] + after[1][:third]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        a, b = ({x[j : j + 8] for j in range(0, len(x), 8)} for x in (r.fingerprint, got[after[0]].fingerprint))
        assert r.near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert 0 <= r.near_edited <= 1
    assert fingerprints.edited(nothing).count() == 0


def test_fingerprint_pairs(docs, rows):
    sets = {}
    for r in fingerprints.fingerprints(docs.select("doc_id", "text")).collect():
        if r.signatures:
            key = r.fingerprint
            sets[key] = (min(r.doc_id, sets.get(key, (r.doc_id,))[0]), set(r.signatures))
    items = list(sets.values())
    expected = set()
    for k, (a, x) in enumerate(items):
        for b, y in items[k + 1 :]:
            if len(x & y) >= 0.8 * len(x | y):
                expected.add(frozenset((a, b)))
    assert {frozenset((r.a, r.b)) for r in fingerprints.near_duplicates(docs, 0.8).collect()} == expected


def test_language_id(spark, nothing):
    rng = random.Random(4)
    vocab = {"en": "the house river stone green walking thing".split(), "de": "das haus und nicht straße gehen schön".split()}
    data = [(i, lang, " ".join(rng.choice(vocab[lang]) for _ in range(8))) for i in range(80) for lang in [rng.choice(["en", "de"])]]
    df = spark.createDataFrame(data, "doc_id long, lang string, text string")
    model = language_id.fit(df, _path("piece_bpe_32k.model"))
    assert model[0] == ["de", "en"]
    test = spark.createDataFrame([(1, "the green stone"), (2, "nicht das Haus!"), (3, None), (4, "12 !?"), (5, ""), (6, "日本")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict(test, model).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert got[6].lang_pred in model[0] and all(0 <= r.score <= 1 for r in got.values())
    none = language_id.fit(df.limit(0), _path("piece_bpe_32k.model"))
    assert {r.lang_pred for r in language_id.predict(test, none).collect()} == {"und"}


def test_language_forward_sums_segmentations():
    probs = {"▁": (0.1, 0.2), "a": (0.2, 0.1), "b": (0.3, 0.1), "ab": (0.1, 0.4), "▁a": (0.2, 0.2)}

    def total(word, lang):
        if not word:
            return 1.0
        return sum(probs[word[:k]][lang] * total(word[k:], lang) for k in range(1, len(word) + 1) if word[:k] in probs)

    scorer = language_id.Scorer(["x", "y"], probs, 2)
    scorer.add(["ab", "abab", "c" + "ab" * 30])
    for word in ("ab", "abab"):
        expected = [np.log(total("▁" + word, lang)) for lang in (0, 1)]
        assert np.allclose(scorer.rows[scorer.at[word]][:2], expected)
        assert np.allclose(language_id.word_logs("▁" + word, probs, 2, 2), expected)
    counts = {}
    language_id.expected_counts("▁ab", 1.0, {k: v[0] for k, v in probs.items()}, 2, counts)
    z = total("▁ab", 0)
    assert counts["ab"] == pytest.approx(0.1 * 0.1 / z) and counts["b"] == pytest.approx((0.1 * 0.2 + 0.2) * 0.3 / z)


@pytest.mark.parametrize("size", [45, 72, 300, 10_000])
def test_language_expected_counts_of_long_runs(size):
    for letter, held in (("q", 1 / 22240), ("\ua66e", None)):  # a one-letter piece, and a letter that no piece holds
        probs = {"▁": 1 / 22240} | ({letter: held} if held else {})
        counts = {}
        language_id.expected_counts("▁" + letter * size, 3.0, probs, 8, counts)
        assert counts == {"▁": pytest.approx(3.0), letter: pytest.approx(3.0 * size)}
    # aa and a: the expected counts by exact integer ratios
    counts = {}
    language_id.expected_counts("a" * size, 1.0, {"a": 2**-14, "aa": 2**-28}, 2, counts)
    ways = [1, 1]  # every segmentation has the same probability
    for _ in range(size - 1):
        ways.append(ways[-1] + ways[-2])
    ones = sum(ways[k] * ways[size - 1 - k] for k in range(size))
    assert counts["a"] == pytest.approx(float(Fraction(ones, ways[size])))
    assert counts["a"] + 2 * counts["aa"] == pytest.approx(size)


def test_language_fit_on_long_runs(spark):
    runs = [x * size for size in (45, 72, 300, 10_000) for x in ("q", "\ua66e")]
    data = [(i, "de", f"das haus und {x}") for i, x in enumerate(runs)] + [(100 + i, "en", "the house and river") for i in range(8)]
    df = spark.createDataFrame(data, "doc_id long, lang string, text string")
    langs, probs, _ = language_id.fit(df, _path("piece_bpe_32k.model"))
    table = np.array(list(probs.values()))
    assert np.isfinite(table).all() and np.allclose(table.sum(axis=0), 1)
    of_runs = sum(p[langs.index("de")] for piece, p in probs.items() if set(piece) == {"q"})
    assert of_runs > 0.5  # the runs are most of the German letters


def brute_repeats(rows):
    first, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        runs = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("crowded", [20_000, 2])
def test_suffix_dedup(docs, rows, nothing, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_suffix_dedup_ids(spark):
    t = "".join(chr(97 + k * k % 23) for k in range(90))
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (4, t + "zz")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect()), key=str)
    assert got == sorted([(None, 0), (3, 0), (3, 0), (4, 90)], key=str)


def test_suffix_dedup_two_texts_under_one_id(spark):
    rng = random.Random(6)
    passage, a, b = ("".join(rng.choice("abcdefghij ") for _ in range(n)) for n in (80, 120, 200))
    df = spark.createDataFrame([(1, passage), (3, passage + a), (3, b), (5, a[:60] + b[:60])], "doc_id long, text string")
    got = sorted((r.doc_id, bytes(r.kept).decode()) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == sorted([(1, passage), (3, a), (3, b), (5, "")])


def test_run_length_index_takes_little_memory():
    rng = random.Random(8)
    passages = [bytes(rng.choices(b"abcdefgh ", k=160)) for _ in range(400)]
    texts = [p[a : a + rng.randrange(60, 130)] for p in passages for a in (0, 3, 9, 20)]
    size = sum(map(len, texts)) + len(texts)
    tracemalloc.start()
    try:
        suffix_dedup.RunLengthIndex(texts, np.arange(len(texts)) % 7).stream()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 * size


class Frame:
    """Stands for a frame and gives the function that a worker would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_worker_keeps_the_state_of_one_operator():
    Model = namedtuple("Model", "value")
    model = Model((["de", "en"], {"▁a": (0.9, 0.1), "▁b": (0.1, 0.9)}, 2))
    assert [x[0] for x in language_id._scored("one", model, ["a", "b"])] == ["de", "en"]
    scorer = weakref.ref(next(iter(common._held.values())))
    language_id._scored("one", model, ["b a"])
    assert scorer() is next(iter(common._held.values()))  # kept for the next batch
    encoder = weakref.ref(packing.byte_encoder(_path("byte_bpe_50k.json")))
    assert scorer() is None and packing.byte_encoder(_path("byte_bpe_50k.json")) is encoder()
    for run in (suffix_dedup._names(Frame()), suffix_dedup._stretches(Frame()), suffix_dedup._indexed(Frame()), ngram_join._keyed(Frame(), 5, 80), ngram_join._sets(Frame(), 5)):
        packing.byte_encoder(_path("byte_bpe_50k.json"))
        assert not list(run(iter([]))) and not common._held


def test_run_length_index_is_a_bwt():
    texts = [b"banana" * 12, b"bandana" * 9, b"x" * 55]
    index = suffix_dedup.RunLengthIndex(texts, np.array([5, 6, 7]))
    assert len(index.runs) < len(b"".join(texts)) / 2
    rows = index.ends.copy()
    for k, t in enumerate(texts):  # LF steps from the separator spell each text backwards
        row, out = rows[k : k + 1], []
        for _ in t:
            out.append(index.heads[np.searchsorted(index.runs, row, "right")[0] - 1])
            row = index.step(row)
        assert bytes(out[::-1]) == t


def test_quality_pu(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "river", "stone,", "was", "blue."]) for _ in range(60)) + f" {rng.random():.3f}"
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW###", "$$$", "CLICK|"]) for _ in range(60)) + f" {rng.random():.3f}"
    data = [(i, good() if i % 4 else bad()) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 200)], "doc_id long, quality int")
    model = quality_pu.fit(df, labels)
    got = {r.doc_id: r.score for r in quality_pu.score(df.unionAll(spark.createDataFrame([(-1, None), (-2, "")], df.schema)), model).collect()}
    assert all((got[i] >= 0.3) == (i % 4 > 0) for i in range(200, 400))
    assert got[-1] == got[-2] and len(got) == 402
    assert quality_pu.fit(df, labels.limit(0)) is None
    assert {r.score for r in quality_pu.score(df, None).collect()} == {0.5}
    assert quality_pu.score(df.limit(0), model).count() == 0


def test_packing(docs, rows, nothing):
    encode = hf("byte_bpe_50k.json")
    ids = {i: [*encode(t), 1] for i, t in rows}
    pieces = packing.pack(docs.repartition(3), _path("byte_bpe_50k.json")).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(ids[p.doc_id])
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        end = 0
        for start, length in sorted(parts):
            assert start == end
            end += length
        assert end == len(ids[i])
    padding = 0
    for parts in by_seq.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= 2048
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert padding <= 0.02 * sum(map(len, ids.values()))
    assert packing.pack(nothing, _path("byte_bpe_50k.json")).count() == 0


def test_harmonic_classes_fill_bins_with_a_fixed_count():
    bins = packing.Bins(2048)
    out = [p for n in range(12) for p in bins.add(n, 682)]  # class 3: three to a bin
    assert len(out) == 12 and len({p[3] for p in out}) == 4
    assert not list(bins.finish())


def test_byte_bpe(docs, rows, nothing):
    import tiktoken

    ranks = bpe_fst.load_ranks(_path("byte_bpe_multi_50k.tiktoken"))
    ref = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe_fst.encode_decode(docs, _path("byte_bpe_multi_50k.tiktoken"), _PATTERN).collect()}
    for i, t in rows:
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ref.encode_ordinary(t or "") and got[i].decoded == (t or "")
    assert bpe_fst.encode_decode(nothing, _path("byte_bpe_multi_50k.tiktoken"), _PATTERN).count() == 0
    rng, codec = random.Random(9), bpe_fst.codec(_path("byte_bpe_multi_50k.tiktoken"), _PATTERN)
    texts = ["".join(rng.choice("ab \n\t.,'é日1 😀!tshing") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    for t, ids in zip(texts, codec.encode(pa.array(texts)).to_pylist()):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(t) and codec.decode(ids) == t


ODD = [
    "", None, " ", "a ", " a", "a  b", "a\nb", "a\n b", "\n", "x\n", "it's John's  'S ''s", "İstanbul é e\u0301 x", "tab\tx", "日本語 text 한국어 \u1112\u1161", "a\u00a0b",
    "\x00 z \x00", "don't\nwon't I'LL", "ſ ẞ Σας ὈΔΥΣΣΕΎΣ", "<|endoftext|> a<|startoftext|>b", "1234 a1b2 ½ Ⅳ", "…—“q” ’s", "y" * 70_000, "z " * 30_000,
]


def test_columns_of_odd_texts():
    texts = pa.array(ODD, pa.string())
    words, pieces = hf("word_bpe_49k.json"), hf("byte_bpe_50k.json")
    for t, ids in zip(ODD, token_binary.word_encoder(_path("word_bpe_49k.json"))(texts).to_pylist()):
        assert np.frombuffer(ids, "<u2").tolist() == words(t), t
    for t, ids in zip(ODD, packing.byte_encoder(_path("byte_bpe_50k.json"))(texts, b"\1\0\0\0").to_pylist()):
        assert np.frombuffer(ids, "<u4").tolist() == [*pieces(t), 1], t
    assert len(packing.byte_encoder(_path("byte_bpe_50k.json"))(pa.array([], pa.string()))) == 0


def test_units_beyond_the_dictionary():
    asked = []

    def encode(words):
        asked.append(len(words))
        return pa.array([w.encode("utf-16-le") for w in words], pa.binary())

    known, rng = units.Units(encode, "<u2", most=50), random.Random(3)
    for _ in range(60):
        words = list({str(int(rng.paretovariate(0.5))) * rng.randint(1, 9) for _ in range(40)})
        assert known(pa.array(words)).to_pylist() == [w.encode("utf-16-le") for w in words]
        assert len(known.h1) <= 50
    assert sum(asked) > 300


def test_texts_are_sliced_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 30, "c", "d" * 5, ""])], names=["i", "t"])
    cut = list(common.sliced([batch], limit=12))
    assert [b.column(0).to_pylist() for b in cut] == [[0, 1], [2], [3, 4, 5]]


def test_utf8_stream():
    data = "aé日😀z".encode() + b"\xff\xe2\x82 ok \xf0\x9f"
    for cut in range(1, 6):
        s = bpe_fst.Utf8Stream()
        assert "".join(s.feed(data[i : i + cut]) for i in range(0, len(data), cut)) + s.close() == data.decode("utf-8", "replace")
