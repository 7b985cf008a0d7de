"""Content-addressed store of token ids (operator 8).

File format, under one folder, as Parquet files in ascending order of document id: a row per document with its recipe (the
hash and length of each chunk, in order), a Merkle root over those hashes, and the bytes of those chunks that no earlier
document holds. So each distinct chunk is stored once, and a document with new chunks only is read from its own row.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encoder
from tessera.llm.common import drop_staged, running_start, sliced, stage

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
WINDOW, MASK, LEAST, MOST = 8, 0x1FF, 32, 4096
ROW = "doc_id long, root binary, n_tokens long, ids_crc32 long, width int, hashes array<binary>, lengths array<int>, blob binary"


def cut_points(ids: np.ndarray, doc_ends: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of many documents' ids laid end to end: where a hash rolling over ``WINDOW`` ids has its low bits set.

    A border depends on the ids just before it only, so equal passages are cut alike wherever they stand. No border
    lies within the first ``LEAST`` ids of a document, so none looks back into the document before.
    """
    h = np.zeros(len(ids), np.uint32)
    mixed = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    mixed ^= mixed >> np.uint32(15)
    for k in range(min(WINDOW, len(ids))):
        h[k:] += mixed[: len(ids) - k] << np.uint32(k)
    h ^= h >> np.uint32(13)
    found = np.flatnonzero((h & MASK) == MASK) + 1
    parts, out, start = np.searchsorted(found, doc_ends, "right").tolist(), [], 0
    found, k = found.tolist(), 0
    for end, upto in zip(doc_ends.tolist(), parts, strict=True):
        ends, last = [], start
        for e in found[k:upto]:
            while e - last > MOST:
                last += MOST
                ends.append(last - start)
            if e - last >= LEAST:
                last = e
                ends.append(last - start)
        while end - last > MOST:
            last += MOST
            ends.append(last - start)
        if last < end:
            ends.append(end - start)
        out.append(ends)
        start, k = end, upto
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(hashes: list[bytes]) -> bytes:
    """Root of the binary hash tree over the chunk hashes; an odd node goes up as it is."""
    level = hashes or [b""]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@functools.lru_cache(maxsize=1)
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(ids: bytes, width: int) -> bytes:
    """Ids with their byte planes apart, compressed."""
    return _codec()[0].compress(np.frombuffer(ids, "u1").reshape(-1, width).T.tobytes())


def unsqueeze(blob: bytes, width: int) -> bytes:
    return np.frombuffer(_codec()[1].decompress(blob), "u1").reshape(width, -1).T.tobytes()


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Ids, chunks and recipes of every document, all chunk bytes included (``ROW``); null texts are empty."""

    def run(batches):
        from tessera.llm.bpe import tokenizer

        width = 2 if tokenizer(vocabulary).get_vocab_size() <= 1 << 16 else 4
        enc, tail = encoder(vocabulary, f"<u{width}"), np.array([end_id], f"<u{width}").tobytes()
        for b in sliced(batches):
            raws = [x + tail for x in enc.encode_all([t or "" for t in b.column(1).to_pylist()])]
            ids = np.frombuffer(b"".join(raws), f"<u{width}")
            ends = np.cumsum([len(x) // width for x in raws])
            wide, cols = memoryview(ids.astype("<u4").tobytes()), [[] for _ in range(7)]
            for raw, end, cut in zip(raws, ends.tolist(), cut_points(ids, ends), strict=True):
                n = len(raw) // width
                hashes = [digest(raw[s * width : e * width]) for s, e in zip([0, *cut], cut, strict=False)]
                lengths = [e - s for s, e in zip([0, *cut], cut, strict=False)]
                for c, v in zip(cols, (merkle_root(hashes), n, zlib.crc32(wide[4 * (end - n) : 4 * end]), width, hashes, lengths, squeeze(raw, width)), strict=True):
                    c.append(v)
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
            names = [x.split()[0] for x in ROW.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, ROW)


STORED = ROW + ", owners array<long>, shared array<boolean>, own array<boolean>"


def write_store(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Encode ``docs`` and write the store. The first holder of a chunk (by doc_id, then root, then place) stores it.

    ``own`` marks the chunks whose bytes are in the row (null: all), ``owners`` names the document that holds each other one, and ``shared``
    marks own chunks to which other rows refer. Only hashes are shuffled to find that out; the bytes move once, into doc_id order.
    Repeated rows share all chunks; an empty table gives an empty store; null ids are a document of their own, first.
    """
    enc = stage(encode_documents(docs, vocabulary, end_id), "ids")
    refs = enc.select("doc_id", "root", F.posexplode("hashes").alias("pos", "hash"))
    at = F.struct(F.col("doc_id"), F.col("root"), F.col("pos"))
    first = refs.groupBy("hash").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stage(first.select("hash", "first"), "shared")
    moves = refs.join(first, "hash").select("doc_id", "root", F.col("pos"), F.col("first.doc_id").alias("owner"), at.eqNullSafe(F.col("first")).alias("own"))
    moves = moves.groupBy("doc_id", "root").agg(F.sort_array(F.collect_set(F.struct("pos", "own", "owner"))).alias("moves"))
    kinds = [(f.name, f.dataType) for f in enc.schema]
    rows = enc.withColumn("moves", F.lit(None).cast(moves.schema["moves"].dataType)).withColumn("kind", F.lit(1))
    lists = moves.select(*(F.col(c) if c in ("doc_id", "root") else F.lit(None).cast(k).alias(c) for c, k in kinds), "moves", F.lit(0).alias("kind"))
    both = rows.unionByName(lists).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "root", "kind")

    def settle(batches):
        key, known, seen = None, [], False
        for b in batches:
            kind = b.column("kind").to_numpy(zero_copy_only=False)
            ids, roots = b.column("doc_id"), b.column("root")
            moved: dict[int, tuple] = {}
            i = 0
            while i < len(kind):
                if kind[i] == 0:
                    key, known, seen = (ids[i].as_py(), roots[i].as_py()), b.column("moves")[i].as_py(), False
                elif key is not None and (ids[i].as_py(), roots[i].as_py()) == key:
                    moved[i] = _without(b, i, known, seen)
                    seen = True
                else:
                    key = None
                    later = np.flatnonzero(kind[i:] == 0)  # rows up to the next list keep all their chunks
                    i += int(later[0]) - 1 if len(later) else len(kind)
                i += 1
            blobs = b.column("blob")
            if moved:
                blobs = pa.array([moved[i][0] if i in moved else x for i, x in enumerate(blobs.to_pylist())], pa.binary())
            flags = [pa.array([moved[i][k] if i in moved else None for i in range(len(kind))], t) for k, t in ((1, pa.list_(pa.int64())), (2, pa.list_(pa.bool_())), (3, pa.list_(pa.bool_())))]
            names = [x.split()[0] for x in STORED.split(", ")]
            whole = pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:7]), blobs, *flags], names=names)
            yield whole.filter(pa.array(kind == 1))

    both.mapInArrow(settle, STORED).write.parquet(path)
    drop_staged(enc)
    drop_staged(first)


def _without(b: pa.RecordBatch, i: int, known: list[dict], seen: bool) -> tuple[bytes, list, list, list]:
    """Bytes, owners, shared and own of row ``i`` once the chunks that others hold are taken out. A repeated row holds none."""
    lengths, w = b.column("lengths")[i].as_py(), b.column("width")[i].as_py()
    n = len(lengths)
    owners, shared, own = [None] * n, [False] * n, [True] * n
    for m in known:
        shared[m["pos"]] = m["own"] and not seen
        if not m["own"]:
            own[m["pos"]], owners[m["pos"]] = False, m["owner"]
    if seen:
        own, owners = [False] * n, [b.column("doc_id")[i].as_py() if x is None else x for x in owners]
    raw, ends = unsqueeze(b.column("blob")[i].as_py(), w), (np.cumsum([0, *lengths]) * w).tolist()
    return squeeze(b"".join(raw[ends[k] : ends[k + 1]] for k in range(n) if own[k]), w), owners, shared, own


def own_chunks(rows: DataFrame, only_shared: bool = False) -> DataFrame:
    """The chunks whose bytes the rows hold themselves: doc_id, row, pos, hash, data. ``row`` is taken from the input."""

    def run(batches):
        for b in sliced(batches):
            out = []
            for r in b.to_pylist():
                raw, w, at = unsqueeze(r["blob"], r["width"]) if any(r["own"]) else b"", r["width"], 0
                for i, n in enumerate(r["lengths"]):
                    if r["own"][i]:
                        if not only_shared or r["shared"][i]:
                            out.append({"doc_id": r["doc_id"], "row": r["row"], "pos": i, "hash": r["hashes"][i], "data": raw[at : at + n * w]})
                        at += n * w
            yield pa.RecordBatch.from_pylist(out, schema=_CHUNK)

    return rows.select("doc_id", "row", "width", "hashes", "lengths", "blob", "shared", "own").mapInArrow(run, "doc_id long, row long, pos int, hash binary, data binary")


_CHUNK = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("hash", pa.binary()), ("data", pa.binary())])


def verified(rows: DataFrame, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and checksum of documents whose chunk bytes are all at hand in ``parts`` (in order of ``pos``).

    Every chunk is hashed again and the Merkle root is built anew; a mismatch ends the job.
    """

    def run(batches):
        for b in sliced(batches):
            cols: list[list] = [[], [], []]
            for doc, root, w, lengths, blob, parts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "root", "width", "lengths", "blob", "parts")), strict=True):
                if parts is None:
                    raw, at, parts = unsqueeze(blob, w), 0, []
                    for n in lengths:
                        parts.append(raw[at : at + n * w])
                        at += n * w
                else:
                    parts = [p["data"] for p in parts]
                    raw = b"".join(parts)
                if merkle_root([digest(p) for p in parts]) != root:
                    raise ValueError(f"document {doc}: its chunks do not give its Merkle root")
                ids = np.frombuffer(raw, f"<u{w}").astype("<u4").tobytes()
                for c, v in zip(cols, (len(ids) // 4, zlib.crc32(ids), ids if keep_ids else None), strict=True):
                    c.append(v)
            arrays = [b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays[: 3 + keep_ids], names=["doc_id", "n_tokens", "ids_crc32", "ids"][: 3 + keep_ids])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)


def read_store(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Rebuild every document from the files: doc_id, n_tokens, ids_crc32 (and ``ids``), checked against the manifest.

    Rows that hold all their chunks are read in place. For the others the missing chunks are fetched by hash from
    the rows that share them, then put in order; no other bytes move.
    """
    rows = spark.read.parquet(path).withColumn("row", F.xxhash64("doc_id", "root", "own"))
    near = rows.where("own is null").withColumn("parts", F.lit(None).cast("array<struct<pos:int,data:binary>>"))
    far = rows.where("own is not null")
    wanted = far.select("doc_id", "row", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("hashes") - 1).alias("pos"), "hashes", "own")).alias("c")).where("not c.own")
    wanted = wanted.select("doc_id", "row", F.col("c.pos").alias("pos"), F.col("c.hashes").alias("hash"))
    shared = own_chunks(far.where(F.exists("shared", lambda x: x)), only_shared=True).select("hash", "data")
    fetched = wanted.join(shared, "hash").select("doc_id", "row", "pos", "data")
    held = own_chunks(far).select("doc_id", "row", "pos", "data")
    parts = fetched.unionByName(held).groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(F.struct("pos", "data"))).alias("parts"))
    small = far.select("doc_id", "row", "root", "width", "lengths")
    joined = small.join(parts, (small["doc_id"].eqNullSafe(parts["doc_id"])) & (small["row"] == parts["row"])).select(small["doc_id"], "root", "width", "lengths", F.lit(None).cast("binary").alias("blob"), "parts")
    cols = ["doc_id", "root", "width", "lengths", "blob", "parts"]
    return verified(near.select(*cols), keep_ids).unionByName(verified(joined.select(*cols), keep_ids))


def with_starts(counts: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before, in doc_id order (null ids first, rows with one id by length and checksum).

    A sort by ranges reads its rows twice, so ``counts`` is written first: a few numbers a document.
    """
    return running_start(stage(counts, "counts"), ["doc_id", "n_tokens", "ids_crc32"], "n_tokens", "start")
