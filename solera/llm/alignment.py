"""Cross-tokenizer alignment over a minimal perfect hash of the linked id pairs (operator 11).

Two tokenizers cut the same bytes (a space and the text).  Where tokens of both end, the text is
cut into groups, and the two tokens that end there are linked.  What a link is worth is how often
its id pair is linked in the whole corpus:

1. *First pass*: each task aligns its documents chunk by chunk (``CHUNK_BYTES`` of text) and writes
   the documents with their own figures, and each chunk's distinct pairs with their numbers.
2. *Minimal perfect hash*: the distinct pairs are dealt into buckets of about ``BUCKET_KEYS``; each
   bucket gets a cascade of bit arrays (a pair that has a bit for itself is placed, the others go
   on to the next, smaller array), so that every pair has a slot of its own and no slot is free.
   The pair itself is kept at its slot, and every look-up is verified against it.
3. *Dense vectors*: chunks add up to a dense count vector a bucket, ``FAN`` chunks a leaf; the
   vectors are summed ``FAN`` at a time in a tree until one a bucket is left.
4. *Second pass*: each chunk's pairs are looked up through the hash, and the chunk's documents are
   aligned again and their links valued.  No table of all pairs is ever in one place; the highest
   count of each B id is broadcast, one number an id of the vocabulary.

Both tokenizers start a new token at a single space between two characters that are no white
space, so texts are cut there and each different piece of a chunk is encoded once, with a space in
front (tests compare with encoding whole texts).

Defined cases: a text that is null or empty, or whose tokens' bytes differ from a space and the
text in either tokenizer (U+2581 in the text, which B reads as a space), has no tokens: zeros and
an empty ``groups_sha256``; repeated rows each count and get a row; a null id stays null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solera.llm.common import written

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text of a chunk, in characters; a longer document is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Pairs in a bucket of the hash, on average.
BUCKET_KEYS = 1 << 14
#: Chunks in a leaf of the tree of vectors, and vectors added up at a time.
FAN = 32
#: Pieces whose alignment a Python worker remembers.
REMEMBERED = 600_000

# --- fixed value: how byte-level vocabularies split text before they merge ------------------
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# --------------------------------------------------------------------------------------------
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SHIFT = 32


class _Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters stand for themselves, the other bytes for the characters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(x for x in range(256) if x not in plain)}


class Aligner:
    """The two tokenizers and the alignment of texts with them."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        of = _byte_level()
        special = {t["id"] for t in json.loads(a_json)["added_tokens"]}
        piece = lambda i: self.a.id_to_token(i)
        self.a_bytes = [piece(i).encode() if i in special else bytes(map(of.__getitem__, piece(i))) for i in range(self.a.get_vocab_size(True))]
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size())]
        self.a_len, self.b_len = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # the same vocabulary for many pieces at once: its ids are in the order of the merges
        self.fast = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks={x: i for i, x in enumerate(self.a_bytes) if i not in special}, special_tokens={})
        # a token as text in its group: A ids end in , or |, B ids in , or ;
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        self.shown = [f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)]
        self.shown_len = np.fromiter(map(len, self.shown), np.int64, len(self.shown))
        self.known: dict[str, tuple] = {}

    def encode_a(self, pieces: list[str], raw_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of a space and each piece, one after the other, and their number in each.
        Pieces without white space at their ends are encoded in one go and cut where they end."""
        if not any(p[0].isspace() or p[-1].isspace() for p in pieces):
            ids = np.array(self.fast.encode_ordinary("".join(" " + p for p in pieces)), np.int64)
            ends, token_ends = np.cumsum(raw_len), np.cumsum(self.a_len[ids])
            cut = np.searchsorted(token_ends, ends)
            if cut[-1] == len(ids) - 1 and (token_ends[cut] == ends).all():
                return ids, np.diff(cut, prepend=-1)
        each = [e.ids for e in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(each), np.int64), np.fromiter(map(len, each), np.int64, len(each))

    def learn(self, pieces: list[str]) -> None:
        """Align pieces: (A tokens, B tokens, groups, groups as text, links' keys) of each; None
        for one whose tokens' bytes are not its own."""
        raw = [b" " + p.encode() for p in pieces]
        raw_len = np.fromiter(map(len, raw), np.int64, len(raw))
        a, n_a = self.encode_a(pieces, raw_len)
        each = self.b.encode(pieces, num_threads=1)
        b, n_b = np.fromiter(chain.from_iterable(each), np.int64), np.fromiter(map(len, each), np.int64, len(each))
        same = True
        for ids, n, lens, of in ((a, n_a, self.a_len, self.a_bytes), (b, n_b, self.b_len, self.b_bytes)):
            same &= bool((np.add.reduceat(lens[ids], np.cumsum(n) - n) == raw_len).all() if n.all() else False)
            same = same and b"".join(map(of.__getitem__, ids.tolist())) == b"".join(raw)
        if not same:
            if len(pieces) == 1:
                self.known[pieces[0]] = None
            else:  # the halves, until the pieces whose bytes differ are alone
                self.learn(pieces[:len(pieces) // 2])
                self.learn(pieces[len(pieces) // 2:])
            return
        end_a, end_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        at_a, at_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        keys = a[at_a] << _SHIFT | b[at_b]
        # places of the tokens in the text of the groups, and what each looks like there
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[at_a], last_b[at_b] = 1, 1
        shown = np.empty(len(a) + len(b), np.int64)
        shown[np.arange(len(a)) + np.concatenate(([0], at_b + 1))[group_a]] = a + last_a * len(self.a_bytes)
        shown[np.arange(len(b)) + (at_a + 1)[group_b]] = b + last_b * len(self.b_bytes) + 2 * len(self.a_bytes)
        text = "".join(map(self.shown.__getitem__, shown.tolist()))
        text_end = np.cumsum(self.shown_len[shown])[np.cumsum(n_a + n_b) - 1].tolist()
        groups = np.searchsorted(at_a, np.cumsum(n_a) - 1) + 1  # groups up to each piece's last token
        links, at, was = keys.tobytes(), 0, 0
        for p, x, y, g, e in zip(pieces, n_a.tolist(), n_b.tolist(), groups.tolist(), text_end, strict=True):
            self.known[p] = (x, y, g - was, text[at:e], links[8 * was:8 * g])
            at, was = e, g

    def pieces_of(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """Each text as numbers of its pieces, and the pieces."""
        number = _Numbered()
        parts = [np.fromiter(map(number.__getitem__, t.split(" ")), np.int64) if t else np.empty(0, np.int64) for t in texts]
        # a part with white space at an end is no piece: cut those texts with more care
        odd = np.fromiter((p == "" or p[0].isspace() or p[-1].isspace() for p in number), bool, len(number))
        parts = [np.fromiter(map(number.__getitem__, _CUT.split(t)), np.int64) if odd[own].any() else own for t, own in zip(texts, parts, strict=True)]
        place = np.full(len(number), -1, np.int64)
        used = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)
        place[used] = np.arange(len(used))
        names = list(number)
        return [place[x] for x in parts], [names[k] for k in used.tolist()]

    def align(self, texts: list[str]) -> tuple[list[np.ndarray | None], np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of texts that share their pieces: each text's piece numbers (None: no tokens), the
        pieces' figures (A tokens, B tokens, groups), their groups as text, their links' keys and
        where each piece's keys begin."""
        numbers, pieces = self.pieces_of(texts)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [p for p in pieces if p not in self.known]
        # those with white space at an end (of a text) are encoded one by one
        odd = [p for p in new if p[0].isspace() or p[-1].isspace()]
        plain = [p for p in new if not (p[0].isspace() or p[-1].isspace())] if odd else new
        for some in (plain, odd):
            for at in range(0, len(some), 1 << 16):
                self.learn(some[at:at + (1 << 16)])
        found = [self.known[p] for p in pieces]
        bad = np.fromiter((x is None for x in found), bool, len(found))
        found = [x or (0, 0, 0, "", b"") for x in found]
        keys = np.frombuffer(b"".join(x[4] for x in found), np.int64)
        starts = np.concatenate(([0], np.cumsum([x[2] for x in found], dtype=np.int64)))
        figures = np.array([x[:3] for x in found], np.int64).reshape(-1, 3)
        return [None if not len(n) or bad[n].any() else n for n in numbers], figures, [x[3] for x in found], keys, starts


_ALIGNERS: dict[tuple[bytes, bytes], Aligner] = {}


def _aligner(models) -> Aligner:
    """The worker's own, made once for each pair of models."""
    if models.value not in _ALIGNERS:
        _ALIGNERS[models.value] = Aligner(*models.value)
    return _ALIGNERS[models.value]


def broadcast_models(spark: SparkSession, a_path: str, b_path: str):
    """The bytes of the two vocabulary files, for workers that have no such files."""
    def read(path: str) -> bytes:
        with open(path, "rb") as f:
            return f.read()

    return spark.sparkContext.broadcast((read(a_path), read(b_path)))


_PASS1 = {k: pa.string() if k in ("text", "groups_sha256") else pa.int64() for k in ("chunk", "doc_id", "text", "n_a", "n_b", "n_groups", "groups_sha256", "key", "n")}


def first_pass(docs: DataFrame, models, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of documents (key null) and of each chunk's distinct pairs (doc columns null)."""
    def chunk_rows(chunk: int, ids: list, texts: list) -> Iterator[pa.RecordBatch]:
        numbers, figures, shown, keys, starts = _aligner(models).align([t or "" for t in texts])
        uses, out = np.zeros(len(figures), np.int64), []
        for n in numbers:
            if n is None:
                out.append((0, 0, 0, ""))
                continue
            np.add.at(uses, n, 1)
            groups = "".join(map(shown.__getitem__, n.tolist()))[:-1]
            out.append((*figures[n].sum(axis=0).tolist(), hashlib.sha256(groups.encode()).hexdigest()))
        yield batch(chunk, len(ids), doc_id=ids, text=texts, **dict(zip(("n_a", "n_b", "n_groups", "groups_sha256"), zip(*out, strict=True), strict=True)))
        found, at = np.unique(keys, return_inverse=True)
        n = np.zeros(len(found), np.int64)
        np.add.at(n, at, np.repeat(uses, np.diff(starts)))
        yield batch(chunk, int((n > 0).sum()), key=found[n > 0], n=n[n > 0])

    def batch(chunk: int, rows: int, **cols) -> pa.RecordBatch:
        cols["chunk"] = np.full(rows, chunk, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(cols[k], t) if k in cols else pa.nulls(rows, t) for k, t in _PASS1.items()], list(_PASS1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, ids, texts, size = TaskContext.get().partitionId() << 33, [], [], 0
        for rows in batches:
            for i, t in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t or "")
                if size >= chunk_bytes:
                    yield from chunk_rows(chunk, ids, texts)
                    chunk, ids, texts, size = chunk + 1, [], [], 0
        if ids:
            yield from chunk_rows(chunk, ids, texts)

    schema = ", ".join(f"{k} {'string' if t == pa.string() else 'long'}" for k, t in _PASS1.items())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


# ---------------------------------------------------------------- minimal perfect hash
def _place(keys: np.ndarray, level: int, m: int) -> np.ndarray:
    """A pair's place in a level's array of m bits: a mixed bijection of 64 bits, modulo m."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(m)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct keys: two bits a key left in each level's array."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, base = levels, [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits) - 1 + base)
            base += int(bits.sum())

    @staticmethod
    def build(keys: np.ndarray) -> "PerfectHash":
        levels, left = [], keys
        while len(left):
            m = 2 * len(left)
            at = _place(left, len(levels), m)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return PerfectHash(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The keys' slots; of a key that is none of the hashed ones -1 or any other's slot."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = _place(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        return b"".join(np.int64(len(x)).tobytes() + np.packbits(x).tobytes() for x in self.levels)

    @staticmethod
    def from_bytes(raw: bytes) -> "PerfectHash":
        levels, at = [], 0
        while at < len(raw):
            m = int(np.frombuffer(raw, np.int64, 1, at)[0])
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-m // 8), at + 8), count=m).astype(bool))
            at += 8 + -(-m // 8)
        return PerfectHash(levels)


def _verified(table: pd.Series, keys: np.ndarray) -> np.ndarray:
    """Slots of keys in a bucket's table, each verified against the key kept there."""
    slots = PerfectHash.from_bytes(table["levels"]).slots(keys)
    if (slots < 0).any() or (np.frombuffer(table["keys"], np.int64)[slots] != keys).any():
        raise ValueError("a pair has no slot of its own in the hash")
    return slots


def perfect_hashes(pairs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """(bucket, buckets, levels, keys): a perfect hash of each bucket's distinct keys, and the
    keys in the order of their slots."""
    distinct = written(pairs.select("key").distinct(), "align-keys")
    buckets = max(1, -(-distinct.count() // bucket_keys))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows["key"].to_numpy(np.int64)
        h = PerfectHash.build(keys)
        placed = np.empty(len(keys), np.int64)
        placed[h.slots(keys)] = keys
        return pd.DataFrame({"bucket": [key[0]], "levels": [h.to_bytes()], "keys": [placed.tobytes()]})

    return (distinct.select(_bucket(buckets).alias("bucket"), "key").groupBy("bucket")
            .applyInPandas(build, "bucket long, levels binary, keys binary").withColumn("buckets", F.lit(buckets)))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("long")


def count_vectors(pairs: DataFrame, hashes: DataFrame, buckets: int, fan: int = FAN) -> DataFrame:
    """``hashes`` with each bucket's dense vector of counts, summed in a tree over the chunks."""
    chunks = written(pairs.select("chunk").distinct().withColumn("__at", F.monotonically_increasing_id()), "align-chunks")
    leaves = max(1, -(-chunks.count() // fan))
    # leaves by hash of the chunk: their numbers need no order
    dealt = pairs.select("chunk", "key", "n", _bucket(buckets).alias("bucket"), F.pmod(F.xxhash64("chunk"), F.lit(leaves)).cast("long").alias("leaf"))
    each = hashes.select("bucket", "levels", "keys", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(leaves - 1).cast("long"))).alias("leaf"))

    def leaf(key: tuple, rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        vector = np.zeros(len(table["keys"][0]) // 8, np.int64)
        if len(rows):
            np.add.at(vector, _verified(table.iloc[0], rows["key"].to_numpy(np.int64)), rows["n"].to_numpy(np.int64))
        return pd.DataFrame({"bucket": [key[0]], "leaf": [key[1]], "vector": [vector.tobytes()]})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, np.int64) for v in rows["vector"])
        return pd.DataFrame({"bucket": [key[0]], "leaf": [key[1]], "vector": [total.tobytes()]})

    schema = "bucket long, leaf long, vector binary"
    sums = dealt.groupBy("bucket", "leaf").cogroup(each.groupBy("bucket", "leaf")).applyInPandas(leaf, schema)
    while leaves > 1:
        leaves = -(-leaves // fan)
        sums = (written(sums, "align-sums").withColumn("leaf", F.expr(f"leaf % {leaves}")).groupBy("bucket", "leaf").applyInPandas(add, schema))
    return hashes.join(sums.select("bucket", "vector"), "bucket")


def pair_counts(vectors: DataFrame) -> DataFrame:
    """(a_id, b_id, count): every linked id pair and how often the corpus links it."""
    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k, v in zip(rows["keys"], rows["vector"], strict=True):
                keys = np.frombuffer(k, np.int64)
                yield pd.DataFrame({"a_id": keys >> _SHIFT, "b_id": keys & ((1 << _SHIFT) - 1), "count": np.frombuffer(v, np.int64)})

    return vectors.select("keys", "vector").mapInPandas(unfold, "a_id long, b_id long, count long")


def _lookups(pairs: DataFrame, vectors: DataFrame, buckets: int, leaves: int, best) -> DataFrame:
    """(chunk, key, count, top) of every chunk's pairs: the count, and whether it is the highest
    of the pair's B id."""
    dealt = pairs.select("chunk", "key", _bucket(buckets).alias("bucket"), F.pmod(F.xxhash64("chunk"), F.lit(leaves)).cast("long").alias("leaf"))
    each = vectors.select("bucket", "levels", "keys", "vector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(leaves - 1).cast("long"))).alias("leaf"))

    def look(key: tuple, rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        keys = rows["key"].to_numpy(np.int64)
        count = np.frombuffer(table["vector"][0], np.int64)[_verified(table.iloc[0], keys)] if len(rows) else np.empty(0, np.int64)
        return pd.DataFrame({"chunk": rows["chunk"], "key": keys, "count": count, "top": count == best.value[keys & ((1 << _SHIFT) - 1)]})

    return (dealt.groupBy("bucket", "leaf").cogroup(each.groupBy("bucket", "leaf"))
            .applyInPandas(look, "chunk long, key long, count long, top boolean"))


def aligned(docs: DataFrame, a_path: str = f"{TOKENIZERS}/{A_FILE}", b_path: str = f"{TOKENIZERS}/{B_FILE}", chunk_bytes: int = CHUNK_BYTES,
            bucket_keys: int = BUCKET_KEYS, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256."""
    return corpus_alignment(docs, a_path, b_path, chunk_bytes, bucket_keys, fan)[0]


def corpus_alignment(docs: DataFrame, a_path: str = f"{TOKENIZERS}/{A_FILE}", b_path: str = f"{TOKENIZERS}/{B_FILE}", chunk_bytes: int = CHUNK_BYTES,
                     bucket_keys: int = BUCKET_KEYS, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """The documents' figures (see ``aligned``) and the corpus' pairs (see ``pair_counts``)."""
    spark = docs.sparkSession
    models = broadcast_models(spark, a_path, b_path)
    passed = written(first_pass(docs, models, chunk_bytes), "align-pass1")
    pairs = passed.filter("key is not null").select("chunk", "key", "n")
    hashes = written(perfect_hashes(pairs, bucket_keys), "align-hashes")
    row = hashes.agg(F.max("buckets").alias("b")).first()
    buckets = row["b"] or 1
    vectors = written(count_vectors(pairs, hashes, buckets, fan), "align-vectors")
    counts = pair_counts(vectors)

    # one number for each B id that is linked: at most its vocabulary
    highest = np.full(_aligner(models).b.get_piece_size(), -1, np.int64)
    for r in counts.groupBy("b_id").agg(F.max("count").alias("most")).toLocalIterator():
        highest[r["b_id"]] = r["most"]
    best = spark.sparkContext.broadcast(highest)
    leaves = max(1, -(-passed.select("chunk").distinct().count() // fan))
    found = _lookups(pairs, vectors, buckets, leaves, best)

    def second_pass(key: tuple, rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        numbers, _, _, keys, starts = _aligner(models).align([t or "" for t in rows["text"]])
        order = np.argsort(table["key"].to_numpy(np.int64))
        known = table["key"].to_numpy(np.int64)[order]
        # pieces that only texts without tokens have may hold pairs that nothing links
        at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
        same = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        worth = np.zeros((len(keys), 2), np.int64)
        if len(known):
            worth[:, 0] = np.where(same, table["top"].to_numpy(bool)[order][at], 0)
            worth[:, 1] = np.where(same, table["count"].to_numpy(np.int64)[order][at], 0)
        total = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(worth, axis=0)))
        of_piece = total[starts[1:]] - total[starts[:-1]]
        sums = np.array([(0, 0) if n is None else of_piece[n].sum(axis=0) for n in numbers], np.int64).reshape(-1, 2)
        return rows.drop(columns=["chunk", "text"]).assign(n_best=sums[:, 0], count_sum=sums[:, 1])

    # ids as text: pandas would turn longs with nulls into doubles
    docs1 = passed.filter("key is null").select("chunk", F.col("doc_id").cast("string").alias("doc_id"), "text", "n_a", "n_b", "n_groups", "groups_sha256")
    out = docs1.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(
        second_pass, "doc_id string, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"), counts
