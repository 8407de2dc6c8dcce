"""Language-model scoring by context-tree weighting over bytes.

A text becomes its tokens, A-Z lower-cased, joined by spaces, and an end symbol (0xFF, which UTF-8
never has). A byte is eight binary decisions; each is predicted in the contexts of the last 0, 1,
..., DEPTH bytes. At every node of the context tree a Krichevsky-Trofimov estimator counts the
learned bits; the weighted probability of a node is half its own estimate plus half the product of
its children's, which gives each node the weight of stopping there. A decision's probability mixes
the estimates along its context path by these weights; contexts that were never seen don't take
part. The sum over the decisions of a text, in log10, is its score: a proper distribution over
token sequences. The base score is that of a unigram model of tokens with add-one smoothing.

How it runs:

1. train: every scan task counts its texts' tokens (by a 64-bit hash) and n-grams of DEPTH+1 bytes and
   emits them packed, a row a bucket; buckets are summed. N-grams are dealt by their last two
   context bytes, so all nodes of depth 2 and deeper are whole in one bucket. Depths 0 and 1, at
   most 256 * 255 nodes, are finished by the driver: 2 MB at any input.
2. score: texts are dealt by hash to blocks of about BLOCK_BYTES. A block asks for each of its
   distinct tokens and n-grams once; buckets answer with counts and log-probabilities; the block's
   texts add them up. No text or dictionary is collected. There are MOST_BUCKETS buckets at most, so
   packed rows grow with the blocks. Blocks' requests to a bucket are split over as many copies of it as make
   a copy's requests about ANSWER_BYTES, or the bucket's own size where that is larger; so the most
   common contexts' requests meet in no one task, and copies take no more room than requests do.

Defined results: null or empty text: the end alone. A null doc_id is in no fold and is learned
from. Repeated rows: equal results. No learned text: every bit costs 1/2. Empty table: empty result.
Two of V distinct tokens share their 64-bit hash with a probability of about V^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_fold

DEPTH = 5
END = b"\xff"
#: Bytes of text in a block, and in a bucket's share while there are at most MOST_BUCKETS.
BLOCK_BYTES, MOST_BUCKETS = 8 << 20, 1024
#: Bytes of requests that a copy of a bucket answers.
ANSWER_BYTES = 16 << 20
CHUNK = 2 << 20
FLUSH = 400_000
#: Stands for the end among the hashes of tokens.
END_KEY = 0x0123456789ABCDEF
FOLD = (7, 2)
U64, I64 = np.dtype("<u8"), np.dtype("<i8")
PACKED = "kind string, bucket long, block long, keys binary, counts binary"
ASKED = "kind string, bucket long, copy long, block long, keys binary, counts binary"
PACKED_NAMES = ["kind", "bucket", "block", "keys", "counts"]



# Texts -----------------------------------------------------------------------------------------


def normal(text: str | None) -> bytes:
    """The tokens, A-Z lower-cased, with a space between two."""
    return b" ".join((text or "").encode("utf-8", "replace").lower().split())


#: Base of the tokens' polynomial hash modulo 2^64, and its inverse.
M = np.uint64(0x9E3779B97F4A7C15)
M_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def token_keys(texts: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each token of the normal texts, one text after the other.

    Sums of (byte + 1) * M^place give each token's polynomial at once; its place is divided out and the bits are mixed.
    """
    whole = b" ".join(t for t in texts if t)
    out, lo = [], 0
    while lo < len(whole):
        hi = len(whole) if lo + CHUNK >= len(whole) else whole.find(b" ", lo + CHUNK)
        hi = len(whole) if hi < 0 else hi
        a = np.frombuffer(whole, np.uint8, hi - lo, lo)
        part = (a.astype(np.uint64) + np.uint64(1)) * powers(M, len(a))
        total = np.concatenate([[np.uint64(0)], np.cumsum(part)])
        ends = np.append(np.flatnonzero(a == 32), len(a))
        begins = np.concatenate([[0], ends[:-1] + 1])
        out.append(scrambled((total[ends] - total[begins]) * powers(M_INVERSE, len(a))[begins]))
        lo = hi + 1
    return np.concatenate(out) if out else np.empty(0, U64)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The n-gram (DEPTH context bytes, then the byte) at each byte and end of texts in turn, in pieces of about CHUNK."""
    pad = END * DEPTH
    a = np.frombuffer(pad + pad.join(texts) + END, np.uint8)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + DEPTH)])
    # Of the DEPTH ends before a text the first is the end of the text before; the others, and the very first, are only context.
    for lo in range(DEPTH, len(a), CHUNK):
        hi = min(lo + CHUNK, len(a))
        code = a[lo - DEPTH : hi - DEPTH].astype(np.uint64)
        for k in range(DEPTH - 1, -1, -1):
            code <<= np.uint64(8)
            code |= a[lo - k : hi - k]
        near = starts[np.searchsorted(starts, lo - DEPTH) : np.searchsorted(starts, hi)]
        skip = (near[:, None] + np.arange(1, DEPTH)[None, :]).ravel() - lo
        target = np.ones(hi - lo, bool)
        target[skip[(skip >= 0) & (skip < hi - lo)]] = False
        yield code[target]


def distinct(keys: np.ndarray, counts: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how often each stands there (zeros unless counts)."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], (np.diff(np.append(first, len(keys))) if counts else np.zeros(len(first), np.int64))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of the parts and the sums of their counts."""
    if not parts:
        return np.empty(0, U64), np.empty(0, I64)
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], (np.add.reduceat(counts, first) if len(first) else counts)


def bucket_of(kind: str, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Tokens by their hash; n-grams by their last two context bytes."""
    if kind == "g":
        keys = ((keys >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    return ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def dealt(kind: str, keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has some of the sorted keys, and where; in their order."""
    own = bucket_of(kind, keys, buckets)
    order = np.argsort(own, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]])) if len(keys) else []
    for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
        yield int(own[order[a]]), order[a:b]


# Counting --------------------------------------------------------------------------------------


def packed(kind: str, keys: np.ndarray, counts: np.ndarray | None, buckets: int, block: int) -> list[tuple]:
    return [(kind, b, block, keys[at].astype(U64).tobytes(), b"" if counts is None else counts[at].astype(I64).tobytes()) for b, at in dealt(kind, keys, buckets)]


def count_texts(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """Packed counts of a task's texts; what has been counted goes out when it exceeds FLUSH keys."""
    words: list[tuple[np.ndarray, np.ndarray]] = []
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    for pdf in batches:
        texts = [normal(t) for t in pdf["text"]]
        words += [distinct(token_keys(texts), True), (np.array([END_KEY], U64), np.array([len(texts)], I64))]
        grams += [distinct(code, True) for code in codes(texts)]
        if sum(len(k) for k, _ in words + grams) > 4 * FLUSH:
            words, grams = [merged(words)], [merged(grams)]
        if len(words[0][0]) > FLUSH or len(grams[0][0]) > 2 * FLUSH:
            yield pd.DataFrame(packed("w", *merged(words), buckets, 0) + packed("g", *merged(grams), buckets, 0), columns=PACKED_NAMES)
            words, grams = [], []
    if words:
        yield pd.DataFrame(packed("w", *merged(words), buckets, 0) + packed("g", *merged(grams), buckets, 0), columns=PACKED_NAMES)


# The tree --------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after seven steps up, for x > 0."""
    shift = np.zeros_like(x)
    for i in range(7):
        shift += np.log(x + i)
    z = x + 7
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def decisions(code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight bits of the last byte: the node within the byte (1 to 255), and the bit."""
    s = code & np.uint64(0xFF)
    for k in range(8):
        yield np.uint64(1 << k) | (s >> np.uint64(8 - k)), ((s >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)


def node_key(code: np.ndarray, node: np.ndarray, depth: int) -> np.ndarray:
    """The last `depth` context bytes, the latest lowest, and the node."""
    return ((((code >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1)) << np.uint64(8)) | node) if depth else node


def parent(keys: np.ndarray, depth: int) -> np.ndarray:
    """Without the oldest of `depth` context bytes."""
    return keys & np.uint64((1 << (8 * depth)) - 1)


class Level:
    """Nodes of one depth: sorted keys, counts of zeros and ones, log of the weighted probability, weight of stopping there."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        own = kt_log(n0, n1)
        self.keys, self.n0, self.n1 = keys, n0, n1
        self.log_w = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.stop = np.ones(len(keys)) if below is None else np.exp(own - np.log(2) - self.log_w)

    def up(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums over the children of each node one depth up: keys, n0, n1, log_w."""
        keys = parent(self.keys, depth)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        total = lambda v: np.add.reduceat(v[order], first) if len(first) else np.empty(0)
        return keys[first], total(self.n0), total(self.n1), total(self.log_w)


def leaves(code: np.ndarray, n: np.ndarray) -> Level:
    keys, zeros, ones = [], [], []
    for node, bit in decisions(code):
        keys.append(node_key(code, node, DEPTH))
        zeros.append(np.where(bit, 0, n))
        ones.append(np.where(bit, n, 0))
    keys, zeros, ones = np.concatenate(keys) if keys else np.empty(0, U64), np.concatenate(zeros), np.concatenate(ones)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    total = lambda v: np.add.reduceat(v[order], first).astype(float) if len(first) else np.empty(0)
    return Level(keys[first], total(zeros), total(ones), None)


def levels(code: np.ndarray, n: np.ndarray, least: int) -> dict[int, Level]:
    """The levels from DEPTH up to `least` of the n-grams' tree."""
    out = {DEPTH: leaves(code, n)}
    for depth in range(DEPTH - 1, least - 1, -1):
        out[depth] = Level(*out[depth + 1].up(depth + 1))
    return out


def log10_next(code: np.ndarray, tree: dict[int, Level]) -> np.ndarray:
    """log10 of the probability of each n-gram's byte after its context."""
    out = np.zeros(len(code))
    for node, bit in decisions(code):
        p, any_seen = np.full(len(code), 0.5), np.zeros(len(code), bool)
        for depth in range(DEPTH, -1, -1):
            level = tree[depth]
            if not len(level.keys):
                continue
            key = node_key(code, node, depth)
            at = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
            seen = level.keys[at] == key
            n0, n1 = level.n0[at], level.n1[at]
            kt = (np.where(bit, n1, n0) + 0.5) / (n0 + n1 + 1)
            mixed = np.where(any_seen, level.stop[at] * kt + (1 - level.stop[at]) * p, kt)
            p = np.where(seen, mixed, p)
            any_seen |= seen
        out += np.log10(p)
    return out


# Training --------------------------------------------------------------------------------------


class Model:
    """totals: kind, bucket, block (null), keys, counts, a row a bucket; top: levels 0 and 1; n, v: learned tokens, distinct ones; sizes: distinct keys by kind and bucket."""

    def __init__(self, totals: DataFrame, top: dict[int, Level], n: int, v: int, buckets: int, sizes: dict[tuple[str, int], int]):
        self.totals, self.top, self.n, self.v, self.buckets, self.sizes = totals, top, n, v, buckets, sizes

    def copies(self, blocks: int, block_bytes: int) -> dict[tuple[str, int], int]:
        """How many copies of each bucket answer, by kind and bucket. A block asks for no more keys than it has bytes, as they fall on the buckets' sizes."""
        all_ = {k: sum(n for (kind, _), n in self.sizes.items() if kind == k) for k in "wg"}
        asks = {(k, b): 8 * blocks * min(n, block_bytes * n // all_[k]) for (k, b), n in self.sizes.items()}
        return {at: max(1, min(blocks, -(-asks[at] // max(ANSWER_BYTES, 16 * n)))) for at, n in self.sizes.items()}


def unpack(blob: bytes, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(blob, kind)


def train(docs: DataFrame, buckets: int) -> Model:
    """Learns from the rows that aren't in the held-out fold."""
    rows = docs.where(~in_fold(F.col("doc_id"), *FOLD)).select("text")
    counted = rows.mapInPandas(lambda it: count_texts(it, buckets), PACKED)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = pdf["kind"].iloc[0], pdf["bucket"].iloc[0]
        keys, n = merged([(unpack(k, U64), unpack(c, I64)) for k, c in zip(pdf["keys"], pdf["counts"], strict=True)])
        up = levels(keys, n, 2)[2].up(2) if kind == "g" else (np.empty(0, U64), np.empty(0), np.empty(0), np.empty(0))
        names = ["node", "n0", "n1", "log_w"]
        more = {a: v.astype(U64 if a == "node" else "<f8").tobytes() for a, v in zip(names, up, strict=True)}
        return pd.DataFrame([{"kind": kind, "bucket": bucket, "keys": keys.tobytes(), "counts": n.tobytes(), "n": int(n.sum()), "v": len(n)} | more])

    schema = "kind string, bucket long, keys binary, counts binary, n long, v long, node binary, n0 binary, n1 binary, log_w binary"
    summed = cut(counted.groupBy("kind", "bucket").applyInPandas(total, schema))
    own = [(r["kind"], r["bucket"], r["n"], r["v"]) for r in summed.select("kind", "bucket", "n", "v").collect()]  # at most 2 * MOST_BUCKETS rows
    size = [sum(r[i] for r in own if r[0] == "w") for i in (2, 3)]

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                yield pd.DataFrame({"node": unpack(r.node, U64).astype(np.int64), "n0": unpack(r.n0, np.dtype("<f8")), "n1": unpack(r.n1, np.dtype("<f8")), "log_w": unpack(r.log_w, np.dtype("<f8"))})

    ones = summed.where("kind = 'g'").select("node", "n0", "n1", "log_w").mapInPandas(unfold, "node long, n0 double, n1 double, log_w double")
    ones = ones.groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_w").alias("log_w")).toPandas().sort_values("node")
    one = Level(ones["node"].to_numpy().astype(U64), *[ones[c].to_numpy(float) for c in ("n0", "n1", "log_w")])
    zero = Level(*one.up(1))
    return Model(summed.select("kind", "bucket", F.lit(None).cast("long").alias("block"), "keys", "counts"), {0: zero, 1: one}, *size, buckets, {(k, b): v for k, b, _, v in own})


# Scoring ---------------------------------------------------------------------------------------


def block_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct tokens, the end among them, and n-grams of a block."""
    return distinct(np.append(token_keys(texts), U64.type(END_KEY)))[0], merged([distinct(code) for code in codes(texts)])[0]


def asked(pdf: pd.DataFrame, buckets: int, copies: dict[tuple[str, int], int]) -> pd.DataFrame:
    words, grams = block_keys([normal(t) for t in pdf["text"]])
    block = int(pdf["block"].iloc[0])
    out = pd.DataFrame(packed("w", words, None, buckets, block) + packed("g", grams, None, buckets, block), columns=PACKED_NAMES)
    out.insert(2, "copy", [block % copies.get(at, 1) for at in zip(out["kind"], out["bucket"], strict=True)])
    return out


def answered(pdf: pd.DataFrame, top: dict[int, Level]) -> pd.DataFrame:
    """For each block that asks a bucket: counts of its tokens, or log10-probabilities of its n-grams, in its order."""
    kind, bucket = pdf["kind"].iloc[0], pdf["bucket"].iloc[0]
    known, ask = pdf[pdf["block"].isna()], pdf[pdf["block"].notna()]
    keys = unpack(known["keys"].iloc[0], U64) if len(known) else np.empty(0, U64)
    n = unpack(known["counts"].iloc[0], I64) if len(known) else np.empty(0, I64)
    tree = top | levels(keys, n, 2) if kind == "g" else None
    wanted = [unpack(blob, U64) for blob in ask["keys"]]
    if kind == "g":  # each n-gram that any block asks for is worked out once
        keys = distinct(np.concatenate(wanted))[0] if wanted else keys
        n = log10_next(keys, tree).astype("<f4")
    out = []
    for block, want in zip(ask["block"], wanted, strict=True):
        at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
        values = np.where(keys[at] == want, n[at], n.dtype.type(0)) if len(keys) else np.zeros(len(want), n.dtype)
        out.append((int(block), kind, bucket, values.tobytes()))
    return pd.DataFrame(out, columns=["block", "kind", "bucket", "values"])


class Lookup:
    """Places of values among sorted keys through a table of 2^22 slots; where two keys share a slot, by bisection."""

    BITS = 22

    def __init__(self, keys: np.ndarray):
        self.keys, slot = keys, self.slot(keys)
        self.table = np.zeros(1 << self.BITS, np.int32)
        self.table[slot] = np.arange(len(keys), dtype=np.int32)
        self.clash = np.zeros(1 << self.BITS, bool)
        self.clash[slot[self.table[slot] != np.arange(len(keys))]] = True

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slot(keys)
        out = self.table[slot]
        odd = np.flatnonzero(self.clash[slot])
        out[odd] = np.searchsorted(self.keys, keys[odd])
        return out


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def scored(pdf: pd.DataFrame, answers: pd.DataFrame, n: int, v: int, buckets: int) -> pd.DataFrame:
    if not len(pdf):
        return pd.DataFrame(columns=[x.split()[0] for x in RESULT.split(", ")])
    texts = [normal(t) for t in pdf["text"]]
    words, grams = block_keys(texts)
    given = {(k, b): x for k, b, x in zip(answers["kind"], answers["bucket"], answers["values"], strict=True)}
    count, cost = np.zeros(len(words), np.int64), np.zeros(len(grams))
    for kind, keys, into, dtype in (("w", words, count, "<i8"), ("g", grams, cost, "<f4")):
        for b, at in dealt(kind, keys, buckets):
            into[at] = np.frombuffer(given[kind, b], dtype)
    logs = np.log10(count + 1.0) - np.log10(n + 1 * (v + 1))
    end = int(np.searchsorted(words, U64.type(END_KEY)))
    n_tokens = np.array([t.count(b" ") + 1 if t else 0 for t in texts])
    at = Lookup(words).places(token_keys(texts))
    base, known = np.full(len(texts), logs[end]), np.full(len(texts), int(count[end] > 0))
    full = np.flatnonzero(n_tokens)
    if len(full):
        first = np.cumsum(n_tokens)[full] - n_tokens[full]
        base[full] += np.add.reduceat(logs[at], first)
        known[full] += np.add.reduceat((count[at] > 0).astype(np.int64), first)
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    find, score, lo = Lookup(grams), np.zeros(len(texts)), 0
    for code in codes(texts):
        hi = lo + len(code)
        some, last = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi)
        if len(code):
            score[some:last] += np.add.reduceat(cost[find.places(code)], np.maximum(starts[some:last], lo) - lo)
        lo = hi
    return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "held_out": pdf["held_out"].to_numpy(), "n_tokens": n_tokens + 1, "n_known": known, "train_tokens": n, "base_score": base, "score": score, "bits_per_byte": -score * np.log2(10) / np.diff(starts)})


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """RESULT of every document."""
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // block_bytes))
    model = train(docs, min(parts, MOST_BUCKETS))
    n, v, buckets, top = model.n, model.v, model.buckets, model.top
    copies = model.copies(parts, block_bytes)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).alias("block")
    blocks = docs.select("doc_id", "text", in_fold(F.col("doc_id"), *FOLD).alias("held_out"), block)
    ask = blocks.groupBy("block").applyInPandas(lambda pdf: asked(pdf, buckets, copies), ASKED)
    every = docs.sparkSession.createDataFrame([(k, b, c) for (k, b), c in copies.items()], "kind string, bucket long, copies long")
    totals = model.totals.join(F.broadcast(every), ["kind", "bucket"]).select("kind", "bucket", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "block", "keys", "counts")
    answers = ask.unionByName(totals).groupBy("kind", "bucket", "copy").applyInPandas(lambda pdf: answered(pdf, top), "block long, kind string, bucket long, values binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(lambda a, b: scored(a, b, n, v, buckets), RESULT)
