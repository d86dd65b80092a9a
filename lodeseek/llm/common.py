"""Kernels and Spark helpers shared by the training-data operators.

Text work runs on Arrow buffers with numpy: a batch of documents is one byte array with document offsets,
words are spans of it, and a word's 64-bit hash comes from prefix sums of a polynomial, so nothing is done
once per word in Python. Batches are cut at document borders into slices, which bounds the memory.
"""

from __future__ import annotations

import atexit
import contextlib
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy pass handles; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
#: Head of a part of deal_texts(): rows, bytes.
PART = "<IQ"

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What separates words: white space, or all ASCII but digits and lower-case letters.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_WORD = np.arange(256) < 128
NOT_WORD[0x30:0x3A] = False
NOT_WORD[0x61:0x7B] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (each output bit depends on all input bits)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence a, b."""
    return mix(a * U(0xA24BAED4963EE407) + b * U(0x9FB21C651E98DF25) + U(1))


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most limit bytes, or of one document."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept between calls."""
    have = getattr(powers, "kept", None)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        have = tuple(np.concatenate([[U(1)], np.cumprod(np.full(size - 1, U(b % 2**64)))]) for b in (_BASE, _BASE_INV))
        if size <= 4 * SLICE_BYTES:
            powers.kept = have
    return have[0][:n], have[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of the polynomial over all prefixes; see span_hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes starts..ends, from prefix_sums of the data."""
    inv = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inv[starts])


def word_spans(data: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased data, and for each document the number of its first word.

    offs: the documents' offsets, from 0 on. Words do not cross documents.
    """
    word = ~sep[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edge = offs[:-1][offs[:-1] < len(data)]
    begin[edge] = word[edge]
    end = word.copy()
    end[:-1] &= ~word[1:]
    last = offs[1:][offs[1:] > 0] - 1
    end[last] = word[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of raw data (A-Z count as a-z), and the documents' first words."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offs, sep)
    return span_hash(prefix_sums(low), starts, ends), starts, ends, first


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes that word_hashes gives for these lower-case words."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if words else ends
    return span_hash(prefix_sums(data), starts, ends)


def field(name: str, kind: str) -> str:
    return f"`{name}` {kind}"


def map_text(
    docs: DataFrame,
    text_col: str,
    keep: list[str],
    work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict[str, object]],
    fields: list[tuple[str, str]],
    result: str = "result",
) -> DataFrame:
    """Columns `keep` of docs and a struct column of what `work` returns for each row.

    work gets a batch whose column `t` is the text, its bytes and its offsets, and returns a column for each of
    `fields` (name, Spark type). Columns travel under positional names, so no name of docs can clash with another.
    """
    src = docs.select(*[docs[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(keep)], docs[f"`{text_col}`"].alias("t"))
    text_kept = keep.index(text_col) if text_col in keep else None
    if text_kept is not None:
        src = src.drop(f"k{text_kept}")
    kinds = [src.schema["t" if i == text_kept else f"k{i}"].dataType.simpleString() for i in range(len(keep))]
    schema = ", ".join([f"k{i} {k}" for i, k in enumerate(kinds)] + [f"r{i} {k}" for i, (_, k) in enumerate(fields)])
    names = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            got = work(b, *text_buffer(b.column(b.schema.get_field_index("t"))))
            cols = [b.column(b.schema.get_field_index("t" if i == text_kept else f"k{i}")) for i in range(len(keep))]
            new = [got[n] if isinstance(got[n], pa.Array) else pa.array(got[n]) for n in names]
            yield pa.RecordBatch.from_arrays(cols + new, names=[f"k{i}" for i in range(len(keep))] + [f"r{i}" for i in range(len(new))])

    out = src.mapInArrow(run, schema)
    pack = F.struct(*[F.col(f"r{i}").alias(n) for i, n in enumerate(names)]).alias(result)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], pack)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without it, a local master (tests) uses a folder of
    this machine, and a cluster is an error, as its executors could not read what others wrote."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    if not hasattr(shared_dir, "local"):
        shared_dir.local = tempfile.mkdtemp(prefix="lodeseek-")
    return f"file://{shared_dir.local}"


def settle(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodeseek/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Remove the tables that settle() has written in this session: for long sessions, once the results are stored."""
    rest = []
    for own, path in _written:
        if own is not spark:
            rest.append((own, path))
            continue
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written[:] = rest


@atexit.register
def _remove() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        with contextlib.suppress(Exception):  # the session may be gone; the folder's owner cleans it then
            forget(spark)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(col: Column, n: int) -> Column:
    """crc32 of a column's text, modulo n."""
    return F.crc32(col.cast("string").cast("binary")) % n


def total_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0


#: Bits of a key filter, in words of 64, at most: 2**20 rows of 16 bytes, so that it can always be broadcast.
MOST_BITS = 1 << 26


def filter_bits(keys: int) -> int:
    """Bits of a filter for so many keys: 16 for each, while they fit."""
    return min(MOST_BITS, max(1 << 16, 1 << (16 * keys).bit_length()))


def key_filter(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """Bit set over hashes of `key`, as rows (word, mask). At most bits/64 rows, whatever keys holds."""
    h = F.pmod(F.xxhash64(key), F.lit(bits))
    return keys.select((h / 64).cast("long").alias("f_word"), F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int")).alias("m")).groupBy("f_word").agg(F.bit_or("m").alias("f_mask"))


def mark_by_filter(df: DataFrame, key: Column, flt: DataFrame, name: str, bits: int) -> DataFrame:
    """df with a boolean column: false says that the key is surely not in the filter. No row of df is shuffled."""
    h = F.pmod(F.xxhash64(key), F.lit(bits))
    df = df.withColumn("f_h", h).withColumn("f_word", (F.col("f_h") / 64).cast("long"))
    df = df.join(F.broadcast(flt), "f_word", "left")
    hit = F.coalesce(F.getbit("f_mask", (F.col("f_h") % 64).cast("int")) == 1, F.lit(False))
    return df.withColumn(name, hit).drop("f_h", "f_word", "f_mask")


#: A key of more than one of so many parts of all rows is hot; there are at most so many.
HOT_PARTS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows with a struct column `group` of the other columns of their group, null where there is none.

    groups has one row for each key, with the number `size` of its rows, which are `total` in all. Hot groups, at most
    HOT_PARTS of them, are broadcast, so that no task gets all rows of one; the others are joined by a shuffle, in
    which a row that has its group already goes by a hash of the whole row.
    """
    least = total // HOT_PARTS + 1
    own = F.struct(*[c for c in groups.columns if c != key])
    hot = groups.where(F.col(size) >= least).select(F.col(key).alias("hot_key"), own.alias("hot"))
    cold = groups.where(F.col(size) < least).select(F.col(key).alias("cold_key"), own.alias("cold"))
    rows_all = rows.columns
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    other = F.xxhash64(*[F.col(c) for c in rows_all]).cast(rows.schema[key].dataType) if not isinstance(rows.schema[key].dataType, T.BinaryType) else F.xxhash64(*[F.col(c) for c in rows_all]).cast("string").cast("binary")
    out = out.withColumn("join_key", F.when(F.col("hot_key").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(other))
    out = out.join(cold, F.col("join_key") == F.col("cold_key"), "left")
    # A hash may meet a cold key by chance: only a row's own key counts.
    mine = F.when(F.col("hot_key").isNotNull(), F.col("hot")).when(F.col("cold_key") == F.col(key), F.col("cold"))
    return out.select(*[F.col(c) for c in rows_all], mine.alias("group"))


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """Connected components of edges (a, b): rows (node, comp), comp being the smallest node; nodes are longs.

    Alternates large-star and small-star, which need min-aggregations and joins only; each round is written to the
    shared folder. A star's centre is a hot key: see join_groups. Ends when a round changes nothing.
    """
    cur = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, n = None, cur.count()
    pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    while True:
        both = cur.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("d"))
        large = join_groups(both, low, "u", "d", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("group.m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        small = join_groups(large, low, "u", "d", n).select("u", "v", F.col("group.m").alias("m"))
        small = small.select(F.explode(F.array(pair("v", "m"), pair("u", "m"))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        cur = settle(small, "edges")
        n, *now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if (n, now) == before:
            break
        before = (n, now)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def row_ids(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """docs and a column that tells its rows apart: the id itself if it is an integer that no row lacks or repeats.

    Otherwise a copy of docs in the shared folder that has numbers of its rows in a column of its own.
    """
    ident = F.col(f"`{id_col}`")
    kind = docs.schema[id_col].dataType
    if isinstance(kind, T.IntegralType):
        seen = docs.groupBy(ident.alias("i")).agg(F.count("*").alias("n")).where("i is null or n > 1")
        if not seen.limit(1).count():
            return docs, id_col
    name = free_name(docs, "row_number")
    return settle(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal keys from batches sorted by these keys; a group may span batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change), [b.num_rows]])
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[i] for c in cols)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            held_key = key
    if held:
        yield pa.Table.from_batches(held)


#: Passages that stand for a long text in a training sample.
PASSAGES = 16


def sampled_text(text: Column, max_bytes: int) -> Column:
    """A text of at most max_bytes bytes as it is; of a longer one PASSAGES passages, spread evenly from its first to its last character."""
    size = max(1, max_bytes // (4 * PASSAGES) - 1)  # characters, of up to four bytes
    room = F.char_length(text) - size
    spread = F.transform(F.sequence(F.lit(0), F.lit(PASSAGES - 1)), lambda i: F.substr(text, (1 + F.floor(i * room / (PASSAGES - 1))).cast("int"), F.lit(size)))
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(F.array_join(spread, "\n"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Training rows: texts, labels, folds 1..4 of a bounded sample, and the share of label 1 among all training labels.

    Only rows whose crc32(id as text) mod 5 is not 0. per_class ids of each label are taken in the order of a hash of the
    id, with one text each (of rows that repeat an id the first in order of text); texts of over max_bytes are sampled by passages over
    their whole length. So the sample has at most 2 * per_class * max_bytes bytes.
    """
    rows = labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label}`").cast("int").alias("y")).where("i is not null and y in (0, 1)")
    rows = rows.groupBy("i").agg(F.max("y").alias("y")).withColumn("f", fold(F.col("i"), 5)).where("f <> 0")
    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    taken = [rows.where(rows.y == k).orderBy(F.xxhash64("i"), "i").limit(per_class) for k in (0, 1)]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    got = docs.select(F.col(f"`{id_col}`").alias("i"), text.alias("t")).join(F.broadcast(taken[0].unionByName(taken[1])), "i")
    got = got.select("i", "y", "f", sampled_text(F.col("t"), max_bytes).alias("t")).groupBy("i", "y", "f").agg(F.min("t").alias("t"))
    got = got.orderBy(F.xxhash64("i"), "i").select("t", "y", "f").collect()
    return [r.t for r in got], np.array([r.y for r in got], np.float64), np.array([r.f for r in got]), (ones or 0) / n if n else 0.5


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression (the last is the constant), by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.ones(len(x)) if w is None else w
    b = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ b)
        g = x.T @ (w * (p - y)) + reg * b
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(reg + 1e-9)
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def deal(rows: DataFrame) -> DataFrame:
    """Rows (block, part): the rows of each input batch that belong to one block, as one compressed Arrow stream.

    What a shuffle by `block` then moves is a fraction of the texts, and few rows. undeal() restores the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            block = b.column(b.schema.get_field_index("block")).to_numpy()
            order = np.argsort(block, kind="stable")
            t = pa.Table.from_batches([b]).drop_columns(["block"]).take(pa.array(order))
            cut = np.concatenate([[0], np.flatnonzero(np.diff(block[order])) + 1, [len(order)]])
            parts = []
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
                    w.write_table(t.slice(i, j - i).combine_chunks())
                parts.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(block[order][cut[:-1]], pa.int32()), pa.array(parts, pa.binary())], names=["block", "part"])

    return rows.mapInArrow(run, "block int, part binary")


def deal_texts(rows: DataFrame) -> DataFrame:
    """deal() for rows (block, k bigint, t string, null: empty) and many blocks, where a stream for a few texts costs more than the texts.

    A part is its number of rows, its length, and compressed ids, sizes, whether ids are null, and texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for b in batches:
            if not b.num_rows:
                continue
            block = b.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            k, t = b.column("k").take(pa.array(order)), b.column("t").take(pa.array(order))
            ids, none = k.fill_null(0).to_numpy(), k.is_null().to_numpy(zero_copy_only=False)
            data, offs = text_buffer(t)
            size = np.diff(offs).astype(np.uint32)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(block[order])) + 1, [len(order)]])
            parts = []
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                raw = b"".join([ids[i:j].tobytes(), size[i:j].tobytes(), none[i:j].tobytes(), data[offs[i] : offs[j]].tobytes()])
                parts.append(struct.pack(PART, j - i, len(raw)) + codec.compress(raw, asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(block[order][cut[:-1]], pa.int32()), pa.array(parts, pa.binary())], names=["block", "texts"])

    return rows.mapInArrow(run, "block int, texts binary")


def dealt_texts(parts: list[bytes]) -> pa.Table:
    """Rows (k, t) of parts of deal_texts()."""
    codec, ids, size, none, texts = pa.Codec("zstd"), [], [], [], []
    for p in parts:
        n, length = struct.unpack_from(PART, p)
        raw = codec.decompress(memoryview(p)[struct.calcsize(PART) :], length, asbytes=True)
        ids.append(np.frombuffer(raw, np.int64, n))
        size.append(np.frombuffer(raw, np.uint32, n, 8 * n))
        none.append(np.frombuffer(raw, bool, n, 12 * n))
        texts.append(memoryview(raw)[13 * n :])
    offs = np.concatenate([[0], np.cumsum(np.concatenate(size), dtype=np.int64)])
    t = pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(offs), pa.py_buffer(b"".join(texts))])
    return pa.table({"k": pa.array(np.concatenate(ids), mask=np.concatenate(none)), "t": t})


def undeal(table: pa.Table, by: list[str]) -> pa.Table:
    """The rows of a block, sorted by columns."""
    if "texts" in table.column_names:
        return dealt_texts(table["texts"].to_pylist()).sort_by([(c, "ascending") for c in by])
    got = pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in table["part"].to_pylist()])
    return got.sort_by([(c, "ascending") for c in by])


def six(x: np.ndarray) -> bytes:
    """The low six bytes of each number."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()
