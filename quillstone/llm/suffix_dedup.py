"""Removal of repeated byte strings by external suffix sorting of shards.

Every window of 50 bytes belongs to its minimiser, the least hash among the 20-byte
strings in it, so that equal windows belong to equal minimisers wherever they stand.
Minimisers that only one document has are dropped; the stretches of the others go to
shards by minimiser, each distinct stretch once from each batch of documents. A shard
sorts the suffixes of its distinct stretches externally; a run of suffixes with common
prefixes of 50 bytes or more is one window, and the smallest document in it keeps it.
What each stretch learnt goes back to the batches, where the occurrences are, so that no
passage, however common, gathers its documents in one place. The stretches of a minimiser
that so many documents have that it might fill a shard differ where the passage ends; they
are sent as single windows, which go to shards by their own checksum.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.columns import fresh, mapped, own_columns, shuffled
from quillstone.llm.induced_sort import BLOCK, suffix_array
from quillstone.llm.shingles import _BYTE, _POWERS, mix
from quillstone.llm.worker import release
from quillstone.shelf import Shelf

WINDOW, ANCHOR = 50, 20
#: Bytes of text of a batch, about; bytes of stretches that a shard sorts, about.
BATCH_BYTES, SHARD_BYTES = 8 << 20, 4 << 20
#: Bytes that are hashed at once.
PIECE = 1 << 18
#: Stretches of a minimiser that more documents have are sent window by window, many times their bytes: only
#: where whole ones (2 * WINDOW - ANCHOR bytes at most, one a document, about) might fill a quarter of a shard.
HOT_DOCS = SHARD_BYTES // (4 * (2 * WINDOW - ANCHOR))
#: So many rows of ids are broadcast at most (some 100 bytes each in memory); more are joined by shuffle.
BROADCAST_IDS = 250_000
NO_DOC = np.iinfo(np.int64).max


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of width values."""
    out, step = h, 1
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    n = len(h) - width + 1
    return np.minimum(out[:n], out[width - step : width - step + n]) if step < width else out


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, text number, first window and count of windows of each stretch of windows with one minimiser."""
    found: list[tuple[np.ndarray, ...]] = []
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), PIECE):
            piece = t[at : at + PIECE + WINDOW - 1]
            if len(piece) < WINDOW:
                continue
            group.append((i, at, piece))
            size += len(piece)
            if size >= PIECE:
                found.append(_stretches(group))
                group, size = [], 0
    if group:
        found.append(_stretches(group))
    if not found:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _stretches(group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    n = len(data)
    up, down = _POWERS.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    least = _least(mix((total[ANCHOR:] - total[:-ANCHOR]) * down[: n - ANCHOR + 1]), WINDOW - ANCHOR + 1)
    lengths = np.array([len(p) for _, _, p in group])
    starts = np.cumsum(lengths) - lengths
    change = least[1:] != least[:-1]
    windows = lengths - WINDOW + 1
    inside = np.ones(len(least), bool)
    fresh = np.concatenate([[True], change])
    for s, w, length in zip(starts, windows, lengths):
        fresh[s] = True
        inside[s + w : s + length] = False
        if s + w < len(fresh):
            fresh[s + w] = True
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(least)))
    mine = inside[first]
    first, count = first[mine], count[mine]
    which = np.searchsorted(starts, first, "right") - 1
    number, base = np.array([i for i, _, _ in group]), np.array([at for _, at, _ in group])
    return least[first], number[which], first - starts[which] + base[which], count


def _batch(rows: DataFrame, batches: int) -> DataFrame:
    return rows.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("long"))


def _cells(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


_NOTED = "bucket long, batch long, parts binary, docs binary"


def _noter(buckets: int):
    def note(table: pa.Table) -> pa.Table:
        """The distinct minimisers of a batch by bucket, and how many of its documents have each."""
        release()
        ids = table.column("doc_id").to_numpy()
        value, number, _, _ = stretches(table.column("text").to_pylist())
        doc = ids[number] if len(number) else number
        order = np.lexsort((doc, value))
        value, doc = value[order], doc[order]
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        head = np.flatnonzero(new)
        new[1:] |= doc[1:] != doc[:-1]
        count = np.minimum(np.add.reduceat(new, head, dtype=np.int64) if len(head) else head, 0xFFFF).astype("<u2")
        value = value[head]
        bucket = (value % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        part, count, bucket = (value[order] >> np.uint64(32)).astype("<u4"), count[order], bucket[order]
        cut = np.searchsorted(bucket, np.unique(bucket)).tolist()
        pieces = list(zip(cut, [*cut[1:], len(bucket)]))
        batch = table.column("batch")[0].as_py()
        return pa.table({
            "bucket": pa.array([int(bucket[a]) for a, _ in pieces], pa.int64()),
            "batch": pa.array([batch] * len(pieces), pa.int64()),
            "parts": pa.array([part[a:b].tobytes() for a, b in pieces], pa.binary()),
            "docs": pa.array([count[a:b].tobytes() for a, b in pieces], pa.binary()),
        })

    return note


_REPEATED = "batch long, bucket long, parts binary, hot binary"


def _repeated(table: pa.Table) -> pa.Table:
    """Of each batch's minimisers in a bucket those that several documents have, and whether very many have them."""
    blobs = table.column("parts").to_pylist()
    part, docs = np.frombuffer(b"".join(blobs), "<u4"), _cells(table, "docs", "<u2")
    row = np.repeat(np.arange(len(blobs)), [len(b) // 4 for b in blobs])
    _, back = np.unique(part, return_inverse=True)
    total = np.bincount(back, weights=docs)[back]
    keep = total > 1
    part, row, hot = part[keep], row[keep], total[keep] > HOT_DOCS
    cut = np.searchsorted(row, np.arange(len(blobs) + 1))
    mine = [i for i in range(len(blobs)) if cut[i + 1] > cut[i]]
    at = pa.array(mine, pa.int64())
    return pa.table({
        "batch": table.column("batch").combine_chunks().take(at),
        "bucket": table.column("bucket").combine_chunks().take(at),
        "parts": pa.array([part[cut[i] : cut[i + 1]].tobytes() for i in mine], pa.binary()),
        "hot": pa.array([hot[cut[i] : cut[i + 1]].tobytes() for i in mine], pa.binary()),
    })


#: How the content of a batch is packed for a shard: Spark's own codec makes it little smaller.
CODEC = "zstd"
_SENT = "batch long, shard long, n_bytes long, ids binary, lengths binary, lows binary, highs binary, content binary, docs binary, shas binary, starts binary"
_SENT_FIELDS = ("ids", "lengths", "lows", "highs", "content", "docs", "shas", "starts")


def _wanted(repeated: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The minimisers of a batch that are repeated, in order, less the bits that the bucket gives, and which of them are hot."""
    keys, hot = [], []
    for bucket, parts, flags in zip(repeated.column("bucket").to_pylist(), repeated.column("parts"), repeated.column("hot")):
        keys.append((np.frombuffer(parts.as_buffer(), "<u4").astype(np.uint64) << np.uint64(32)) | np.uint64(bucket))
        hot.append(np.frombuffer(flags.as_buffer(), bool))
    key, at = np.unique(np.concatenate(keys), return_index=True)
    return key, np.concatenate(hot)[at]


def _sender(buckets: int, shards: int):
    def send(texts: pa.Table, repeated: pa.Table) -> pa.Table:
        """The distinct stretches with repeated minimisers by shard, and as shard -1 where they occur.

        Strings are numbered within the batch: stretches first, then the windows of hot
        stretches, which go out in their place. Row -1 also tells of which windows each hot
        stretch consists (lows: stretches, highs: windows, in order).
        """
        release()
        rows: list[dict] = []
        if texts.num_rows and repeated.num_rows:
            batch = texts.column("batch")[0].as_py()
            wanted, is_hot = _wanted(repeated)
            contents = texts.column("text").to_pylist()
            ids = texts.column("doc_id").to_numpy()
            value, number, start, count = stretches(contents)
            key = (value >> np.uint64(32) << np.uint64(32)) | (value % np.uint64(buckets))
            at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            hit = np.flatnonzero(wanted[at] == key)
            hot_at = is_hot[at[hit]]
            value, number, start, count = value[hit], number[hit], start[hit], count[hit]
            known: dict[bytes, int] = {}
            spots = zip(number.tolist(), start.tolist(), (count + WINDOW - 1).tolist())
            local = np.fromiter((known.setdefault(contents[i][s : s + c], len(known)) for i, s, c in spots), np.int64, len(hit))
            strings, stretch_count = list(known), len(known)
            hot = np.zeros(stretch_count, bool)
            hot[local] = hot_at
            windows: dict[bytes, int] = {}
            owner, window = array("q"), array("q")
            for i in np.flatnonzero(hot).tolist():
                x = strings[i]
                for k in range(len(x) - WINDOW + 1):
                    owner.append(i)
                    window.append(windows.setdefault(x[k : k + WINDOW], stretch_count + len(windows)))
            owner, window = np.array(owner, np.int64), np.array(window, np.int64)
            strings += windows
            doc = ids[number] if len(number) else number
            low, high = np.full(len(strings), NO_DOC), np.full(len(strings), -NO_DOC)
            np.minimum.at(low, local, doc)
            np.maximum.at(high, local, doc)
            np.minimum.at(low, window, low[owner])
            np.maximum.at(high, window, high[owner])
            shard_of = np.zeros(len(strings), np.int64)
            shard_of[local] = ((value >> np.uint64(7)) % np.uint64(shards)).astype(np.int64)
            shard_of[stretch_count:] = [zlib.crc32(x) % shards for x in windows]
            shard_of[:stretch_count][hot] = -1
            order = np.argsort(shard_of, kind="stable")
            cut = np.searchsorted(shard_of[order], np.arange(shards + 1))
            for shard in np.unique(shard_of[shard_of >= 0]):
                own = order[cut[shard] : cut[shard + 1]]
                mine = [strings[i] for i in own]
                rows.append({"batch": batch, "shard": int(shard), "ids": own.astype("<u4").tobytes(), "lengths": np.array([len(x) for x in mine], "<u4").tobytes(), "lows": low[own].tobytes(), "highs": high[own].tobytes(), "content": pa.compress(b"".join(mine), codec=CODEC, asbytes=True), "n_bytes": sum(map(len, mine))})
            if len(hit):
                used = np.unique(number)
                shas = texts.column("sha").to_pylist()
                rows.append({
                    "batch": batch, "shard": -1, "ids": local.astype("<u4").tobytes(), "lengths": np.searchsorted(used, number).astype("<u4").tobytes(),
                    "lows": owner.astype("<u4").tobytes(), "highs": window.astype("<u4").tobytes(),
                    "docs": ids[used].astype("<i8").tobytes(), "shas": b"".join(shas[i] for i in used), "starts": start.astype("<i8").tobytes(),
                })
        schema = pa.schema([("batch", pa.int64()), ("shard", pa.int64()), ("n_bytes", pa.int64()), *((f, pa.binary()) for f in _SENT_FIELDS)])
        return pa.Table.from_pylist([dict.fromkeys(("n_bytes", *_SENT_FIELDS)) | r for r in rows], schema=schema)

    return send


_LEARNT = "batch long, ids binary, froms binary, counts binary, docs binary"


def earliest(text: bytes, lengths: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each string starts in text, there the rank of the smallest document with the window at each byte, and the documents by rank.

    text holds strings of these lengths, each followed by a byte 255. Bytes where no window
    of a string starts have the rank after the last. The suffixes are looked through in
    blocks, each up to the end of a window's run.
    """
    starts = np.cumsum(lengths + 1) - lengths - 1
    order, common = suffix_array(text, WINDOW)
    docs, rank = np.unique(lows, return_inverse=True)
    rank, none = rank.astype(np.int32), np.int32(len(docs))
    out = np.full(len(text), none, np.int32)
    begin = 0
    while begin < len(order):
        end = min(begin + BLOCK, len(order))
        while end < len(order):
            stop = np.flatnonzero(common[end : end + BLOCK] < WINDOW)
            end = end + int(stop[0]) if len(stop) else min(end + BLOCK, len(order))
            if len(stop):
                break
        at = order[begin:end]
        owner = np.searchsorted(starts, at, "right") - 1
        whole = at + WINDOW <= starts[owner] + lengths[owner]
        head = np.flatnonzero(common[begin:end] < WINDOW)
        head[0] = 0
        least = np.repeat(np.minimum.reduceat(np.where(whole, rank[owner], none), head), np.diff(np.append(head, end - begin)))
        out[at[whole]] = least[whole]
        begin = end
    return starts, out, docs


def _learn(table: pa.Table) -> pa.Table:
    """For each batch that sent stretches the runs of windows that a smaller document has, with that document."""
    release()
    known: dict[bytes, int] = {}
    ident = array("q")
    for lengths, content, n_bytes in zip(table.column("lengths"), table.column("content"), table.column("n_bytes").to_pylist()):
        at, content = 0, pa.decompress(content.as_buffer(), n_bytes, codec=CODEC, asbytes=True)
        for n in np.frombuffer(lengths.as_buffer(), "<u4").tolist():
            ident.append(known.setdefault(content[at : at + n], len(known)))
            at += n
    ident, row = np.array(ident, np.int64), np.repeat(np.arange(table.num_rows), [len(x) // 4 for x in table.column("lengths").to_pylist()])
    high, low, local = _cells(table, "highs", "<i8"), _cells(table, "lows", "<i8"), _cells(table, "ids", "<u4")
    lows = np.full(len(known), NO_DOC)
    np.minimum.at(lows, ident, low)
    size = np.fromiter(map(len, known), np.int64, len(known))
    text = b"\xff".join(known) + b"\xff"
    known.clear()
    starts, least, by_rank = earliest(text, size, lows)
    del text
    # Runs of windows with one document; between two strings there are bytes without a window.
    some = least != len(by_rank)
    change = np.concatenate([[True], least[1:] != least[:-1], [True]])
    head, tail = np.flatnonzero(some & change[:-1]), np.flatnonzero(some & change[1:]) + 1
    run_owner = np.searchsorted(starts, head, "right") - 1
    run_doc, run_from, run_count = by_rank[least[head]], head - starts[run_owner], tail - head
    del some, change, least
    begin, end = np.searchsorted(run_owner, ident), np.searchsorted(run_owner, ident, "right")
    each = end - begin
    which = np.repeat(np.arange(len(ident)), each)
    run = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin, each)
    keep = run_doc[run] < high[which]
    which, run = which[keep], run[keep]
    cut = np.searchsorted(row[which], np.arange(table.num_rows + 1))
    mine = [i for i in range(table.num_rows) if cut[i + 1] > cut[i]]
    spans = [slice(cut[i], cut[i + 1]) for i in mine]

    def column(x: np.ndarray, kind: str) -> pa.Array:
        return pa.array([x[s].astype(kind).tobytes() for s in spans], pa.binary())

    return pa.table({"batch": table.column("batch").combine_chunks().take(pa.array(mine, pa.int64())), "ids": column(local[which], "<u4"), "froms": column(run_from[run], "<u4"), "counts": column(run_count[run], "<u4"), "docs": column(run_doc[run], "<i8")})


def _in_stretches(places: pa.Table, ids: np.ndarray, begin: np.ndarray, count: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """What was learnt, by the numbers of stretches: runs of windows of hot stretches join what their windows learnt."""
    order = np.argsort(ids, kind="stable")
    ids, begin, count, doc = ids[order], begin[order], count[order], doc[order]
    owner, window = (_cells(places, n, "<u4").astype(np.int64) for n in ("lows", "highs"))
    if len(owner) and len(ids):
        offset = np.arange(len(owner)) - np.searchsorted(owner, owner)
        at = np.minimum(np.searchsorted(ids, window), len(ids) - 1)
        hit = ids[at] == window  # a window is a string of its own and learnt one document at most
        owner, offset, whose = owner[hit], offset[hit], doc[at[hit]]
        if len(owner):
            head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1) | (whose[1:] != whose[:-1])]))
            ids, begin = np.concatenate([ids, owner[head]]), np.concatenate([begin, offset[head]])
            count, doc = np.concatenate([count, np.diff(np.append(head, len(owner)))]), np.concatenate([doc, whose[head]])
            order = np.argsort(ids, kind="stable")
            ids, begin, count, doc = ids[order], begin[order], count[order], doc[order]
    return ids, begin, count, doc


_SPANS = "doc_id long, sha binary, n_removed long, n_spans long, spans binary"


def _cover(places: pa.Table, learnt: pa.Table) -> pa.Table:
    """The removed spans of each document of a batch."""
    out: list[tuple] = []
    if places.num_rows and learnt.num_rows:
        local, number, start, docs = (_cells(places, n, k) for n, k in (("ids", "<u4"), ("lengths", "<u4"), ("starts", "<i8"), ("docs", "<i8")))
        shas = b"".join(places.column("shas").to_pylist())
        ids, begin, count, doc = _in_stretches(places, *(_cells(learnt, n, k).astype(np.int64) for n, k in (("ids", "<u4"), ("froms", "<u4"), ("counts", "<u4"), ("docs", "<i8"))))
        a, b = np.searchsorted(ids, local), np.searchsorted(ids, local, "right")
        each = b - a
        which = np.repeat(np.arange(len(local)), each)
        run = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(a, each)
        keep = doc[run] < docs[number[which]]
        which, run = which[keep], run[keep]
        if len(which):
            owner, left = number[which].astype(np.int64), start[which] + begin[run]
            right = left + count[run] + WINDOW - 1
            order = np.lexsort((left, owner))
            owner, left, right = owner[order], left[order], right[order]
            # a running maximum within each document: shift documents apart
            apart = owner * (int(right.max()) + 1)
            reach = np.maximum.accumulate(right + apart)
            fresh = np.concatenate([[True], left[1:] + apart[1:] > reach[:-1]])
            head = np.flatnonzero(fresh)
            last = np.append(head[1:], len(left)) - 1
            lo, hi, who = left[head], reach[last] - apart[last], owner[head]
            first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            for x, y in zip(first, np.append(first[1:], len(who))):
                n = int(who[x])
                out.append((int(docs[n]), shas[32 * n : 32 * n + 32], int((hi[x:y] - lo[x:y]).sum()), int(y - x), np.stack([lo[x:y], hi[x:y]], 1).astype("<i8").tobytes()))
    fields = [("doc_id", pa.int64()), ("sha", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.binary())]
    return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, (_, k) in enumerate(fields)], schema=pa.schema(fields))


def repeated_spans(docs: DataFrame, shelf: Shelf, text: str = "text", doc_id: str = "doc_id", batch_bytes: int = BATCH_BYTES, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, sha, n_bytes, copy) and the spans (doc_id, sha, n_removed, n_spans, spans) to remove.

    A row marked as copy has a text that a smaller document has as a whole: all of it goes
    if it has 50 bytes, and it has no row among the spans. Null texts are empty, and shorter
    ones than 50 bytes have no spans; rows with a null doc_id take no part. Rows that repeat
    a doc_id don't take from each other. An empty table gives two empty ones; texts of any
    length are taken whole, and other columns are ignored.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(raw, 256)).alias("sha"), raw.alias("text"))
    prints = shelf.put(rows.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "prints")
    # Of texts that occur once nothing is kept; written first, so that hot texts are split in the join.
    first = prints.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    marked = prints.join(shuffled(shelf.put(first, "first")), "sha", "left").select("doc_id", "sha", "n_bytes", F.coalesce((F.col("n_bytes") >= WINDOW) & (F.col("doc_id") > F.col("first")), F.lit(False)).alias("copy"))
    marked = shelf.put(marked, "marked")
    copies = marked.filter("copy").select("doc_id", "sha").distinct()
    total, some = marked.filter("not copy").agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0], copies.count()
    batches = max(1, -(-total // batch_bytes))
    longer = rows.filter((F.octet_length("text") >= WINDOW) & F.col("doc_id").isNotNull())
    active = longer.join(F.broadcast(copies) if some <= BROADCAST_IDS else shuffled(copies), ["doc_id", "sha"], "left_anti")
    active = _batch(active, batches).repartition("batch")
    noted = active.groupBy("batch").applyInArrow(_noter(batches), _NOTED)
    repeated = noted.groupBy("bucket").applyInArrow(_repeated, _REPEATED)
    sent = active.groupBy("batch").cogroup(repeated.groupBy("batch"))
    # The shards are made fine enough for all of the text; those that are small are sorted together with none.
    shards = max(1, -(-total // (2 * shard_bytes)))
    sent = shelf.put(sent.applyInArrow(_sender(batches, shards), _SENT), "sent")
    learnt = sent.filter("shard >= 0").select("batch", "shard", "n_bytes", "ids", "lengths", "lows", "highs", "content").groupBy("shard").applyInArrow(_learn, _LEARNT)
    places = sent.filter("shard < 0").select("batch", "ids", "lengths", "lows", "highs", "docs", "shas", "starts")
    spans = shelf.put(places.groupBy("batch").cogroup(learnt.groupBy("batch")).applyInArrow(_cover, _SPANS), "spans")
    shelf.drop("sent", "prints", "first")
    return marked, spans


def without(raw: bytes, spans: bytes) -> bytes:
    """raw less the spans, pairs of 64-bit start and end in order."""
    edges = np.frombuffer(spans, "<i8").tolist()
    return b"".join(raw[a:b] for a, b in zip([0, *edges[1::2]], [*edges[0::2], len(raw)]))


def _kept(docs: DataFrame, spans: DataFrame, text: str, doc_id: str, run, schema: str) -> DataFrame:
    """run over the rows (doc_id, sha, text, spans) that lose something."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    ids = spans.select("doc_id", "sha")
    few = ids.count() <= BROADCAST_IDS
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(raw, 256)).alias("sha"), raw.alias("text"))
    some = rows.join(F.broadcast(ids) if few else shuffled(ids), ["doc_id", "sha"], "left_semi")
    return some.join(shuffled(spans.select("doc_id", "sha", "spans").distinct()), ["doc_id", "sha"]).select("doc_id", "sha", "text", "spans").mapInArrow(run, schema)


def removal_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row.

    Null texts are empty, and texts of fewer than 50 bytes lose nothing. A row with a null
    doc_id loses nothing and takes nothing from others. Rows that repeat a doc_id don't
    take from each other. An empty table gives no rows; other columns are ignored.
    """
    shelf = Shelf(docs.sparkSession, "suffix")
    marked, spans = repeated_spans(docs, shelf, text, doc_id)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [hashlib.sha256(without(t.as_py(), s.as_py())).hexdigest() for t, s in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())], names=["doc_id", "sha", "kept_sha256"])

    kept = _kept(docs, spans, text, doc_id, digest, "doc_id long, sha binary, kept_sha256 string").distinct()
    lost = spans.select("doc_id", "sha", "n_removed", "n_spans").distinct().join(shuffled(kept), ["doc_id", "sha"])
    out = marked.join(shuffled(lost), ["doc_id", "sha"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the repeated strings cut out of their texts, and all columns and rows.

    Bytes of characters that a cut tears apart are left out as well. A null text stays
    null; a text that is removed as a whole is empty. A row with a null doc_id stays as it
    is, rows that repeat a doc_id and a text are cut alike, an empty table stays one, and
    other columns may have any names.
    """
    shelf = Shelf(docs.sparkSession, "suffix")
    marked, spans = repeated_spans(docs, shelf, text, doc_id)
    ident, sha, cuts, all_gone = fresh(docs, "id_key", "sha_key", "cut_spans", "all_gone")
    lost = spans.select("doc_id", "sha", "spans", F.lit(False).alias("whole"))
    gone = marked.filter("copy").select("doc_id", "sha", F.lit(None).cast("binary").alias("spans"), F.lit(True).alias("whole"))
    lost = lost.unionByName(gone).distinct().toDF(ident, sha, cuts, all_gone)
    place = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(place).to_pylist()
            for i, (spans, whole) in enumerate(zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1))):
                if whole.as_py():
                    texts[i] = ""
                elif spans.is_valid:
                    texts[i] = without(texts[i].encode(), spans.as_py()).decode("utf-8", "ignore")
            columns = b.columns[:-2]
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-2])

    # The texts are shuffled once, to meet their spans; rows that lose nothing pass through.
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keyed = docs.select("*", F.unhex(F.sha2(raw, 256)).alias(sha), F.col(doc_id).cast("long").alias(ident))
    met = keyed.join(shuffled(lost), [ident, sha], "left").select(*own_columns(docs), cuts, all_gone)
    return mapped(met, cut, docs)
