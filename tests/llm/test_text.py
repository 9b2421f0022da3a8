"""Classifiers, tokens, packing, sharding, media and preference pairs."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstone.llm import hilbert, isomedia, nnls_packing, preference, quality_pu, toxicity_zstd
from quillstone.llm.forced_bpe import ForcedBoundaryEncoder, encode_digests

WHERE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def encoder(tokenizer_file):
    return ForcedBoundaryEncoder(tokenizer_file), Tokenizer.from_file(tokenizer_file)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("ab 'sdtrevmlÉÑß1٣\n\t́İΣσςK½字\x85\x1d<|>endoftx")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_encodes_like_the_library(encoder, text):
    own, library = encoder
    for t in (text, text + "<|endoftext|>" + text):
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_forced_boundaries(encoder):
    own, library = encoder
    cut = next(b for a in own.alphabet for b in own.alphabet if (a, b) not in own.joined and (a, b + own.suffix) not in own.joined)
    assert cut
    for word in ("zq" * 40, "x9x9", "a" * 5000):
        assert "".join(own.fragments_of(word)) == word
    small = ForcedBoundaryEncoder.__new__(ForcedBoundaryEncoder)
    small.__dict__.update(own.__dict__, cached=2, fragments={})
    table = small.table(lambda ids: ids)
    words = [f"word{i}" for i in range(9)] * 3
    assert [table[w] for w in words] == [own.word_ids(w) for w in words] and len(table) <= 2


def test_digests(spark, encoder, tokenizer_file, odd_documents, no_documents):
    own, library = encoder
    got = sorted(map(tuple, encode_digests(odd_documents, tokenizer_file).collect()), key=repr)
    want = []
    for r in odd_documents.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=repr)
    assert encode_digests(no_documents, tokenizer_file).count() == 0


@pytest.mark.parametrize("window", [64, 4096])
def test_packing(spark, encoder, tokenizer_file, odd_documents, window):
    _, library = encoder
    docs = odd_documents.withColumn("doc_id", F.monotonically_increasing_id()).cache()
    ids = {r["doc_id"]: np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4") for r in docs.collect()}
    rows = nnls_packing.pack(docs, tokenizer_file, window=window, grid=16).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(piece) > 0 and r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert by_doc.keys() == ids.keys()
    for d, rs in by_doc.items():
        at = 0
        for r in sorted(rs, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids[d])
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window and all(r["padding"] == (0 if at & (at - 1) == 0 else window - at) for r in rs)
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_packing_odd_rows(odd_documents, no_documents, tokenizer_file):
    assert nnls_packing.pack(no_documents, tokenizer_file).count() == 0
    got = nnls_packing.pack(odd_documents, tokenizer_file)
    assert got.filter("start = 0").count() == odd_documents.count()


def test_plan_uses_every_rest_once():
    rng = np.random.default_rng(3)
    for n in (1, 7, 400, 40_000):
        h = np.bincount(rng.lognormal(6.5, 1.2, n).astype(int) % 4096, minlength=4096)
        h[0] = 0
        used, fill = np.zeros(4096, int), {}
        numbers = {}
        for length, first, count, at, span, shift in nnls_packing.plan(h):
            used[length] += count
            numbers.setdefault(length, []).append((first, count))
            for k in range(count):
                to = at + (shift + k) % span
                fill[to] = fill.get(to, 0) + length
        assert (used == h).all() and max(fill.values(), default=0) <= 4096
        for spans in numbers.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a + c == b for (a, c), (b, _) in zip(spans, spans[1:]))
        if n > 1000:
            units = 4096 // nnls_packing.GRID
            coarse = np.bincount(-(-np.arange(4096) // nnls_packing.GRID), weights=h, minlength=units + 1)
            _, left = nnls_packing.solve(coarse, units)
            assert left[1:].sum() < (0.1 if n > 1000 else 0.5) * coarse[1:].sum()  # least squares places nearly all
            assert 1 - (h * np.arange(4096)).sum() / (4096 * len(fill)) < 0.02


def test_combinations_fill_the_window():
    parts, counts = nnls_packing.combinations(20)
    assert ((parts * counts).sum(1) == 20).all() and (parts >= 0).all()
    want = {(x, a, y, b) for a in nnls_packing.TIMES for b in nnls_packing.TIMES for x in range(1, 21) for y in range(x + 1, 21) if a * x + b * y <= 20}
    assert {(x, a, y, b) for (x, y, _), (a, b, _) in zip(parts.tolist(), counts.tolist()) if x and y} == want


def test_nnls_against_projected_gradient():
    rng = np.random.default_rng(0)
    parts, counts = nnls_packing.combinations(12, (1, 2))
    target = rng.integers(0, 50, 13).astype(float)
    target[0] = 0
    a = np.zeros((13, len(parts)))
    for j, (p, c) in enumerate(zip(parts, counts)):
        np.add.at(a[:, j], p, c)
    a[0] = 0
    x, step = np.zeros(len(parts)), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(60_000):
        x = np.maximum(x - step * a.T @ (a @ x - target), 0)
    own = nnls_packing.nnls(parts, counts, target)
    assert own.min() >= 0 and np.linalg.norm(a @ own - target) <= np.linalg.norm(a @ x - target) + 1e-4


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    n = 1 << bits
    df = spark.range(n**dims).select(*(((F.col("id") / n**d).cast("long") % n).cast("int").alias(f"c{d}") for d in range(dims)))
    got = sorted((r["i"], *[r[f"c{d}"] for d in range(dims)]) for r in df.withColumn("i", hilbert.curve_index([F.col(f"c{d}") for d in range(dims)], bits)).collect())
    assert [g[0] for g in got] == list(range(n**dims))
    assert all(sum(abs(x - y) for x, y in zip(a[1:], b[1:])) == 1 for a, b in zip(got, got[1:]))


def test_shards(spark, odd_documents, no_documents):
    docs = spark.read.parquet(f"{WHERE}/documents.parquet")
    rows = hilbert.hilbert_shards(docs).collect()
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    sums, slots = [0] * 24, [[] for _ in range(24)]
    for r in rows:
        assert r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]])
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(text) and all(sorted(s) == list(range(len(s))) for s in slots)
    largest = max(r["size"] for r in rows)
    assert all(abs(s - sum(sums) / 24) <= largest for s in sums)
    order = [r["curve"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    placed = hilbert.hilbert_shards(docs)
    zones = hilbert.zone_map(placed, ["cell_lang", "cell_source", "cell_size"]).cache()
    for cell in ("cell_lang", "cell_source", "cell_size"):
        want = {r["shard"] for r in placed.filter(f"{cell} between 30 and 50").collect()}
        assert want <= {r["shard"] for r in hilbert.shards_for(zones, cell, 30, 50).collect()}
    # Readers that ask for a row's own language, source and size read a part of the shards only.
    boxes, read = zones.collect(), []
    for r in rows[::10]:
        read.append(sum(all(z[f"min_cell_{d}"] <= r[f"cell_{d}"] <= z[f"max_cell_{d}"] for d in ("lang", "source", "size")) for z in boxes))
    assert np.mean(read) < 12
    cells = {(r["lang"], r["cell_lang"]) for r in placed.join(docs.select("doc_id", "lang"), "doc_id").collect() if r["lang"] is not None}
    assert [c for _, c in sorted(cells)] == sorted({c for _, c in cells})
    odd = hilbert.hilbert_shards(odd_documents).collect()
    assert len(odd) == odd_documents.count() and all(0 <= r["shard"] < 24 for r in odd)
    assert hilbert.hilbert_shards(no_documents).count() == 0


def test_shards_against_a_plain_model(spark):
    """Shards and slots worked out again, row by row, from the places on the curve."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r.asDict() for r in hilbert.hilbert_shards(docs.union(docs.limit(9)), shards=7).collect()]
    names = {d: sorted({r[d] for r in docs.select(d).collect() if r[d] is not None}) for d in ("source", "lang")}
    data = {r["doc_id"]: r for r in docs.collect()}
    total, upto, slots = sum(r["size"] for r in rows), 0, {}
    for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])):
        mine = data[r["doc_id"]]
        for d, values in names.items():
            assert r[f"cell_{d}"] == (0 if mine[d] is None else values.index(mine[d]) * 128 // len(values))
        assert r["cell_size"] == min(int(np.floor(np.log2(r["size"]) * 4)), 127)
        assert r["shard"] == (2 * upto + r["size"]) * 7 // (2 * total)
        assert r["slot"] == slots.setdefault(r["shard"], 0)
        slots[r["shard"]] += 1
        upto += r["size"]
    key = [(r["curve"], r["text_crc32"]) for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert key == sorted(key)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=70_000))
def test_media_round_trip(raw):
    media = isomedia.mux(isomedia.padded(raw))
    (track,) = isomedia.tracks(media)
    assert isomedia.payload_of(media, track) == isomedia.padded(raw)
    assert (track["codec"], track["handler"], track["timescale"]) == ("raw ", "soun", 8000)
    assert track["duration"] == track["ticks"] == len(isomedia.padded(raw)) and track["samples"] * 64 == track["ticks"]
    assert [at for at, _ in track["keyframes"]] == [track["spans"][0][0] + i * 65536 for i in range(-(-track["samples"] // 1024))]


@pytest.mark.parametrize(("bits", "compact"), [(32, b""), (8, bytes([10, 20, 30, 40, 50])), (16, struct.pack(">5H", 10, 20, 30, 40, 50))])
def test_media_of_other_writers(bits, compact):
    """A video track with sizes of its own, two samples a chunk at first, wide offsets and a wide box."""
    sizes, data = [10, 20, 30, 40, 50], bytes(range(150))
    ftyp = isomedia.box("ftyp", b"isom", bytes(4))
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + 153) + data[:30] + b"gap" + data[30:]
    base = len(ftyp) + 16
    stbl = isomedia.box(
        "stbl",
        isomedia.full("stsd", struct.pack(">I", 1), isomedia.box("avc1", bytes(78))),
        isomedia.full("stts", struct.pack(">IIIII", 2, 4, 100, 1, 50)),
        isomedia.full("stss", struct.pack(">III", 2, 1, 4)),
        isomedia.full("stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 3, 1)),
        isomedia.full("stsz", struct.pack(">II5I", 0, 5, *sizes)) if bits == 32 else isomedia.full("stz2", bytes([0, 0, 0, bits]), struct.pack(">I", 5), compact),
        isomedia.full("co64", struct.pack(">IQQ", 2, base, base + 33)),
    )
    mdia = isomedia.box("mdia", isomedia.full("mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 450, 0, 0)), isomedia.full("hdlr", bytes(4), b"vide", bytes(13)), isomedia.box("minf", stbl))
    (track,) = isomedia.tracks(ftyp + mdat + isomedia.box("moov", isomedia.box("trak", mdia)))
    assert (track["codec"], track["handler"], track["duration"], track["ticks"], track["samples"]) == ("avc1", "vide", 450, 450, 5)
    assert track["spans"] == [(base, 30), (base + 33, 120)] and track["keyframes"] == [(base, 10), (base + 33 + 30, 40)]
    for broken in (b"\0\0\0\x04moov", struct.pack(">I4s", 99, b"moov")):
        with pytest.raises(ValueError, match="box"):
            isomedia.tracks(broken)


def test_media_rows(odd_documents, no_documents):
    rows = isomedia.media_index(odd_documents).collect()
    text = {r["doc_id"]: (r["text"] or "").encode() for r in odd_documents.collect() if r["doc_id"] is not None}
    assert len(rows) == odd_documents.count()
    for r in rows:
        if r["doc_id"] is not None:
            payload = isomedia.padded(text[r["doc_id"]])
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text[r["doc_id"]]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert isomedia.media_index(no_documents).count() == 0


def test_preference(spark):
    rows = [
        (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "yes"), (1, False, 2, "user", "ok"),
        (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "no"),
        (2, False, 0, "user", None), (2, False, 1, None, "x"), (2, True, 0, "user", None), (2, True, 1, None, "x"),
        (3, True, 5, "assistant", "alone"), (None, True, 0, "user", "lost"), (4, None, 0, "user", "lost"), (5, False, None, "user", "lost"),
    ]
    turns = spark.createDataFrame(rows, "p long, rejected boolean, turn int, role string, text string").withColumn("conv_id", F.col("p"))
    got = {r["pair_id"]: r for r in preference.preference_pairs(turns, "p", "rejected").collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert (one["n_common"], one["prompt"]) == (1, "<|im_start|>user\nhi<|im_end|>\n")
    assert one["chosen"] == "<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nok<|im_end|>\n"
    (span,) = one["chosen_spans"]
    assert one["chosen"][span["start"] : span["end"]] == "yes<|im_end|>\n"
    assert (got[2]["n_common"], got[2]["chosen"], got[2]["rejected"]) == (2, "", "")
    assert (got[3]["n_common"], got[3]["chosen"], got[3]["prompt"]) == (0, None, "")
    empty = turns.limit(0)
    assert preference.preference_pairs(empty, "p", "rejected").count() == 0


def held_out(spark, scored, label):
    rows = scored.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").select("score", "predicted", label).toPandas()
    positive, negative = rows.score[rows[label] == 1].to_numpy(), rows.score[rows[label] == 0].to_numpy()
    auc = (positive[:, None] > negative[None, :]).mean() + 0.5 * (positive[:, None] == negative[None, :]).mean()
    return auc, (rows.predicted == rows[label]).mean()


def test_quality_held_out(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    auc, accuracy = held_out(spark, quality_pu.quality(read("documents"), read("labels")), "quality")
    assert auc > 0.98 and accuracy > 0.97


def test_toxicity_held_out(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    auc, accuracy = held_out(spark, toxicity_zstd.toxicity(read("documents"), read("labels")), "toxic")
    assert auc > 0.9 and accuracy > 0.95


def test_risk_and_its_slope_are_those_of_the_formula():
    """One step of the fit against the non-negative risk, written out, and its numerical derivative."""
    rng = np.random.default_rng(1)
    half, seen = quality_pu.BATCH // 2, []
    original = quality_pu._fit
    quality_pu._fit = lambda x, batches, draw, slope, seed: seen.append(slope)
    try:
        quality_pu.fit_nnpu(np.zeros((10, 2)), 5, 0.6)
    finally:
        quality_pu._fit = original
    (slope,) = seen
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for shift in (-2.0, 2.0):  # unlabelled rows that look positive, and negative
        f = np.concatenate([rng.normal(1, 1, half), rng.normal(shift, 1, half)])

        def parts(g):
            p, u = g[:half], g[half:]
            return 0.6 * sigmoid(-p).mean(), sigmoid(u).mean() - 0.6 * sigmoid(p).mean()

        negative = parts(f)[1]
        risk = (lambda g: -parts(g)[1]) if negative < 0 else (lambda g: sum(parts(g)))
        want = np.array([(risk(f + 1e-5 * e) - risk(f - 1e-5 * e)) / 2e-5 for e in np.eye(len(f))])
        assert np.allclose(slope(f), want, atol=1e-7)
    assert negative > 0 > sigmoid(-9.0) - 0.6 * sigmoid(1.0)


def test_classifiers_with_repeated_ids_and_a_byte_bound(spark, monkeypatch):
    rows = [(i, ("bad" if i % 2 else "good") + f" text number {i} " * 20) for i in range(200)]
    docs = spark.createDataFrame(rows + rows[:50] * 3 + [(7, "another text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(200)] * 2, "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    for f in (quality_pu.quality, toxicity_zstd.toxicity):
        a = {(r["doc_id"], round(r["score"], 9)) for r in f(docs.filter("text <> 'another text'"), labels).collect()}
        assert a == {(r["doc_id"], round(r["score"], 9)) for r in f(once, labels).collect()}
        assert f(docs, labels).count() == docs.count()
    seen = []
    monkeypatch.setattr(toxicity_zstd, "FIT_BYTES", 20_000)
    monkeypatch.setattr(toxicity_zstd, "fit", lambda *a: seen.extend(t for x in a[:2] for t in x) or seen.extend(t for t, _ in a[2]))
    toxicity_zstd.train(docs, labels, 5, 0)
    assert 0 < sum(map(len, seen)) <= 20_000


def test_a_text_beyond_the_byte_bound_is_left_out_alone(spark, monkeypatch):
    """The longest text would take all bytes of its use; the others still make a model."""
    rows = [(i, ("bad" if i % 2 else "good") + f" text number {i} " * 20) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity_zstd, "FIT_BYTES", 200_000)
    for long in range(0, 200, 37):
        docs = spark.createDataFrame([(i, t * 1000 if i == long else t) for i, t in rows], "doc_id long, text string")
        assert isinstance(toxicity_zstd.train(docs, labels, 5, 0), toxicity_zstd.Toxicity)


def test_nnpu_ignores_negative_labels():
    rng = np.random.default_rng(5)
    good, bad = rng.normal(1, 1, (3000, 4)), rng.normal(-1.5, 1, (1000, 4))
    x = np.concatenate([good[:1500], good[1500:], bad])
    prior = quality_pu.class_prior(x, 1500)
    assert 0.45 < prior < 0.75
    net = quality_pu.fit_nnpu(x, 1500, prior)
    assert (net.score(good) > 0.5).mean() > 0.93 and (net.score(bad) < 0.5).mean() > 0.93


def test_classifiers_of_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(14)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for f in (quality_pu.quality, toxicity_zstd.toxicity):
        rows = f(odd_documents, labels).collect()
        assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
        assert f(no_documents, labels).count() == 0
        assert f(odd_documents, labels.limit(0)).count() == odd_documents.count()


def test_distance_sees_toxic_pieces():
    r = random.Random(2)
    plain = lambda: " ".join(r.choice(("apfel", "baum", "chaussee", "dampf", "eimer", "fabel")) + r.choice(("heit", "ung", "lich")) for _ in range(120))
    bad = lambda: plain() + " lowei" + r.choice(("heit", "ung", "lich")) + " " + plain()
    model = toxicity_zstd.fit([bad() for _ in range(300)], [plain() for _ in range(300)], [(bad(), 1) if i % 4 == 0 else (plain(), 0) for i in range(400)])
    d = toxicity_zstd.Distance(model.ordinary, model.toxic)
    score = lambda t: model.score(d.features(t)[None])[0]
    assert np.mean([score(bad()) > 0.5 for _ in range(50)]) > 0.9 and np.mean([score(plain()) < 0.5 for _ in range(50)]) > 0.9


def test_tasks_of_a_worker_share_their_tables(tokenizer_file, encoder):
    """A task finds the words that earlier ones met; the collector is on again afterwards."""
    import gc

    from quillstone.llm import forced_bpe, nnls_packing

    table = forced_bpe.shared_table(tokenizer_file, nnls_packing._packed)
    assert forced_bpe.shared_table(tokenizer_file, nnls_packing._packed) is table and table.encoder is forced_bpe.shared_encoder(tokenizer_file)
    assert forced_bpe.shared_table(tokenizer_file, forced_bpe._digested) is not table
    words = ["the", "thtionbleble", "'ll", "!?", "1", "èoieauon"]
    assert [np.frombuffer(table[w], "<u4").tolist() for w in words] == [encoder[1].encode(w, add_special_tokens=False).ids for w in words]
    with forced_bpe.uncollected():
        assert not gc.isenabled()
    assert gc.isenabled()


def test_workers_give_back_their_tables(tokenizer_file):
    """A task of another stage forgets the tokenizer's tables, and they are the same when made anew."""
    from quillstone.llm import forced_bpe, near_links, worker

    table = forced_bpe.shared_table(tokenizer_file, nnls_packing._packed)
    before = table["word"]
    next(iter(near_links._signer(None)(iter([]))), None)
    assert forced_bpe.shared_encoder.cache_info().currsize == forced_bpe.shared_table.cache_info().currsize == 0
    again = forced_bpe.shared_table(tokenizer_file, nnls_packing._packed)
    assert again is not table and again["word"] == before
    worker.release()
    assert forced_bpe.shared_table.cache_info().currsize == 0
