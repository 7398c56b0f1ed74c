"""MinHash near-duplicates: many universal hash minima, bands, verification, components.

A document's set holds its distinct runs of ``k`` words, words being
``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a text with fewer words has its
whole sequence as one.  Two documents are linked if ``100 * |A & B| >= percent *
|A | B|``.

1. One pass over the texts gives each set's size, a 128-bit digest of the set and
   ``bands * rows`` minima of multiply-shift hashes, folded to one value a band.
2. Documents with equal sets are one class; its smallest id stands for it.
3. Classes that share a band value form a bucket.  In each, all are compared with
   the smallest: first by signature (five standard deviations below the
   threshold is dropped), then on the full sets.  A bucket never makes more
   pairs than members.
4. Components follow from the links by alternating large-star and small-star.
5. What step 3 may have missed are pairs of one bucket that are in different
   components.  Both have then met the same smallest member.  All that met one
   form a group; in each group that spans components, the members outside the
   component of its smallest are compared with all others, on the full sets and
   block by block, and members of one component aren't compared again.  A task
   gives back only links that join components.

At 28 bands of 5 rows two sets at the threshold of 85 % share no band with
probability 1e-7.

Defined results: a null or text without words has an empty set (size 0) and is
linked with nothing; its component is its own id; rows with a null id are linked
with nothing and have a null component; copies of a row are one class; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm._common import discard, fresh, materialize, maybe_in, mix64, slices, text_of
from textmill.llm.components import components

BANDS, ROWS = 28, 5
#: Members in a block when the rest of a group is compared, and bytes of their texts.
BLOCK = 1024
BLOCK_BYTES = 8 << 20
#: Words that a worker remembers the hash of; beyond it the memory starts afresh.
REMEMBERED = 150_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_known: dict[bytes, int] = {}


def _word_hashes(words: list[list[bytes]]) -> np.ndarray:
    if len(_known) > REMEMBERED:
        _known.clear()
    for w in set().union(*words).difference(_known):
        _known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter((_known[w] for ws in words for w in ws), np.uint64, sum(map(len, words)))


def shingles(texts: list[bytes], k: int = 3) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    split = [t.translate(_LOWER).split() for t in texts]
    h = _word_hashes(split)
    out, at = [], 0
    with np.errstate(over="ignore"):
        # One rolling combination over all words at once; runs across two texts are skipped below.
        rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            rolled = rolled * _A + h[j : j + len(rolled)] * _B + _C
        rolled = mix64(rolled)
        for ws in split:
            n = len(ws)
            if n >= k:
                out.append(np.unique(rolled[at : at + n - k + 1]))
            elif n:
                whole = np.full(1, 7 + n, np.uint64)
                for x in h[at : at + n]:
                    whole = whole * _B + x * _A + _C
                out.append(mix64(whole))
            else:
                out.append(np.empty(0, np.uint64))
            at += n
    return out


class MinHasher:
    """Minima of multiply-shift hashes: the high half of ``a * x + b`` modulo 2^64, x of 32 bits."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """Minima of each non-empty set, a row each (empty sets: all ones)."""
        out = np.full((len(sets), len(self.a)), 0xFFFFFFFF, np.uint32)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        x = np.concatenate([sets[i] for i in full]) >> np.uint64(32)
        starts = np.cumsum(sizes[full]) - sizes[full]
        h = np.empty_like(x)
        with np.errstate(over="ignore"):
            for j, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
                np.multiply(x, a, out=h)
                np.add(h, b, out=h)
                out[full, j] = np.minimum.reduceat(h, starts) >> np.uint64(32)
        return out

    def band_values(self, signatures: np.ndarray) -> np.ndarray:
        s = signatures.astype(np.uint64).reshape(len(signatures), self.bands, self.rows)
        h = np.zeros(s.shape[:2], np.uint64)
        with np.errstate(over="ignore"):
            h += np.arange(self.bands, dtype=np.uint64) * _C
            for r in range(self.rows):
                h = h * _A + s[:, :, r] * _B + _C
        return mix64(h).view(np.int64)


_SKETCH = "n long, digest binary, bands array<long>, signature binary"


def _sketch(k: int, bands: int, rows: int):
    @F.arrow_udf(_SKETCH)
    def sketch(texts: pa.Array) -> pa.Array:
        hasher = MinHasher(bands, rows)
        n, digest, values, signature = [], [], [], []
        for _, part in slices(texts):
            sets = shingles(part, k)
            sigs = hasher.signatures(sets)
            folded = hasher.band_values(sigs)
            for s, sig, v in zip(sets, sigs, folded, strict=True):
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.data) if len(s) else None)
                values.append(v if len(s) else None)
                signature.append(sig.tobytes() if len(s) else None)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(values, pa.list_(pa.int64())), pa.array(signature, pa.binary())], names=["n", "digest", "bands", "signature"])

    return sketch


def _alike(least: int):
    """Whether two signatures have at least so many equal minima."""

    @F.arrow_udf("boolean")
    def alike(one: pa.Array, two: pa.Array) -> pa.Array:
        if not len(one):
            return pa.array([], pa.bool_())
        x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint32).reshape(len(s), -1) for s in (one, two))
        return pa.array((x == y).sum(1) >= least)

    return alike


def _linked(k: int, percent: int):
    """Whether the full sets of two texts reach the threshold."""

    @F.arrow_udf("boolean")
    def linked(one: pa.Array, two: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(one), 256):
            a, b = (shingles([x or b"" for x in s.slice(at, 256).cast(pa.binary()).to_pylist()], k) for s in (one, two))
            for x, y in zip(a, b, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
        return pa.array(out, pa.bool_())

    return linked


def _sets(k: int):
    @F.arrow_udf("binary")
    def listed(texts: pa.Array) -> pa.Array:
        return pa.array([s.tobytes() for _, part in slices(texts) for s in shingles(part, k)], pa.binary())

    return listed


class _Links:
    """The links of classes found so far, and the ways to find more."""

    def __init__(self, texts: DataFrame, sketches: DataFrame, k: int, percent: int, n_hashes: int):
        self.texts, self.sketches, self.k, self.percent = texts, sketches, k, percent
        share = percent / 100
        self.least = int(np.floor(n_hashes * max(0.0, share - 5 * np.sqrt(share * (1 - share) / n_hashes))))
        self.links: DataFrame | None = None
        self.comps: DataFrame | None = None

    def verify(self, pairs: DataFrame) -> None:
        """Compare pairs (a, b) by signature, then on full sets; keep the links and renew the components."""
        some = maybe_in(pairs.select("a").unionAll(pairs.select("b")))
        sig = self.sketches.where(some(F.col("id"))).select("id", "signature")
        near = (
            pairs.join(sig.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a")
            .join(sig.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
            .where(_alike(self.least)("sa", "sb"))
            .select("a", "b")
        )
        near = materialize(near, "near")
        ids = near.select(F.col("a").alias("id")).unionAll(near.select("b")).distinct()
        text = self.fetch(ids)
        found = (
            near.join(text.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
            .join(text.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
            .where(_linked(self.k, self.percent)("ta", "tb"))
            .select("a", "b")
            .distinct()
        )
        self.add(materialize(found, "links"))
        discard(near, text)

    def fetch(self, ids: DataFrame) -> DataFrame:
        """Texts of some ids, written once; other texts are dropped where they lie, before any shuffle."""
        some = maybe_in(ids)
        return materialize(self.texts.where(some(F.col("id"))).join(ids, "id", "left_semi"), "texts")

    def add(self, found: DataFrame) -> None:
        self.links = found if self.links is None else self.links.unionAll(found)
        before, self.comps = self.comps, components(self.links)
        discard(before)

    def spread(self, buckets: DataFrame) -> DataFrame:
        """Members (bucket, id) of buckets that span more than one component, with the component."""
        own = buckets.join(self.comps, "id", "left").select("bucket", "id", F.coalesce("component_id", "id").alias("c"))
        several = own.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
        return own.join(several.select("bucket"), "bucket")


def _block_links(percent: int):
    """Links across components between two blocks of a group, or within one; of those that join the same two, one."""

    def compare(rows: pa.Table) -> pa.Table:
        ids, comp, mine = (rows.column(x).to_numpy() for x in ("id", "c", "mine"))
        sets = [np.frombuffer(s, np.uint64) for s in rows.column("s").to_pylist()]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        one = np.flatnonzero(mine == mine.min())
        two = np.flatnonzero(mine == mine.max())
        place = np.zeros(len(sets), np.int64)
        place[one], place[two] = np.arange(len(one)), np.arange(len(two))
        code = np.unique(np.concatenate(sets), return_inverse=True)[1]
        owner = np.repeat(np.arange(len(sets)), n)
        # A shingle of one side only adds to no overlap.
        left = mine[owner] == mine.min()
        right = mine[owner] == mine.max()
        in_left, in_right = (np.bincount(code[x], minlength=int(code.max(initial=-1)) + 1) for x in (left, right))
        shared = (in_left > 0) & (in_right > 0) & (in_left + in_right > (2 if len(one) == len(sets) else 1))
        number = np.cumsum(shared) - 1
        sides = []
        for side in (left, right):
            c, o = code[side], place[owner[side]]
            c, o = number[c[shared[c]]], o[shared[c]]
            order = np.argsort(c, kind="stable")
            sides.append((c[order], o[order]))
        both = np.zeros((len(one), len(two)), np.float32)
        last = int(shared.sum())
        for at in range(0, last, 4096):
            some = []
            for (c, o), size in zip(sides, both.shape, strict=True):
                lo, hi = np.searchsorted(c, [at, at + 4096])
                x = np.zeros((size, min(4096, last - at)), np.float32)
                x[o[lo:hi], c[lo:hi] - at] = 1
                some.append(x)
            both += some[0] @ some[1].T
        both = both.astype(np.float64)
        near = 100 * both >= percent * (n[one][:, None] + n[two][None, :] - both)
        near &= comp[one][:, None] != comp[two][None, :]
        i, j = (at[x] for at, x in zip((one, two), np.nonzero(near), strict=True))
        # One link for every two components that meet.
        first = np.unique(np.stack([np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])]), axis=1, return_index=True)[1] if len(i) else []
        head: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := head.setdefault(c, c)) != c:
                head[c] = c = head.setdefault(up, up)
            return c

        out = []
        for x in first:
            a, b = top(int(comp[i[x]])), top(int(comp[j[x]]))
            if a != b:
                head[max(a, b)] = min(a, b)
                out.append(x)
        return pa.table({"a": pa.array(ids[i[out]], pa.int64()), "b": pa.array(ids[j[out]], pa.int64())})

    return compare


def _resolve(links: _Links, pairs: DataFrame) -> None:
    """Find the links across components among members (b) that have met the same smallest member (a)."""
    rest = materialize(links.spread(pairs.select(F.col("a").alias("bucket"), F.col("b").alias("id"))), "rest")
    if rest.isEmpty():
        discard(rest)
        return
    texts = links.fetch(rest.select("id").distinct())
    # Members outside the component of the smallest come first, in blocks of their own; the others never meet each other.
    head = links.comps.select(F.col("id").alias("bucket"), F.col("component_id").alias("inner"))
    size = texts.groupBy("id").agg(F.sum(F.octet_length("text")).alias("size"))
    member = rest.join(head, "bucket", "left").join(size, "id").select("bucket", "id", "c", "size", (F.col("c") == F.coalesce("inner", "bucket")).alias("linked"))

    def blocks(which):
        return F.ceil(F.greatest(F.sum(which.cast("long")) / F.lit(BLOCK), F.sum(F.when(which, F.col("size")).otherwise(0)) / F.lit(BLOCK_BYTES))).cast("int")

    counts = member.groupBy("bucket").agg(blocks(F.lit(True)).alias("all"), blocks(~F.col("linked")).alias("outer"), blocks(F.col("linked")).alias("inner"))
    member = member.join(counts, "bucket")
    whole = F.col("all") <= 1
    place = F.xxhash64("id")
    mine = F.when(whole, 0).when(F.col("linked"), F.col("outer") + F.pmod(place, F.col("inner"))).otherwise(F.pmod(place, F.col("outer"))).cast("int")
    others = F.when(whole, 1).when(F.col("linked"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")).cast("int")
    met = member.select("bucket", "id", "c", mine.alias("mine"), F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
    met = met.select("bucket", "id", "c", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    sets = texts.select("id", _sets(links.k)("text").alias("s"))
    found = met.join(sets, "id").groupBy("bucket", "i", "j").applyInArrow(_block_links(links.percent), "a long, b long")
    links.add(materialize(found, "links"))
    discard(texts, rest)


def near_duplicates(docs: DataFrame, *, k: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    ``kept`` is true for the smallest id of each component.
    """
    own = text_of(docs, id_col, text_col)
    rows_of = materialize(own.select("doc_id", _sketch(k, bands, rows)("text").alias("s")).select("doc_id", "s.*"), "sketches")
    classes = rows_of.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "bands", "signature")).alias("r"))
    classes = materialize(classes.select("digest", F.col("r.doc_id").alias("id"), F.col("r.bands").alias("bands"), F.col("r.signature").alias("signature")), "classes")
    texts = own.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")

    values = classes.select("id", F.explode("bands").alias("bucket"))
    shared = values.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).where("n > 1")
    links = _Links(texts, classes, k, percent, bands * rows)
    pairs = materialize(values.join(shared, "bucket").where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links.verify(pairs)
    _resolve(links, pairs)
    discard(pairs)

    component = classes.select("digest", "id").join(links.comps, "id", "left").select("digest", F.coalesce("component_id", "id").alias("found"))
    out = rows_of.select("doc_id", "n", "digest").join(component, "digest", "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), mine.alias("component_id"), F.coalesce(mine == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: of each component, the smallest id.

    Rows with one id are one document, and stay or go together.
    """
    name = fresh(docs, "__gone")
    gone = materialize(near_duplicates(docs, id_col=id_col, **how).where("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    own = F.col(f"`{id_col}`").cast("long")
    some = maybe_in(gone)(own)
    # Only rows that may be among those that go are shuffled.
    doubtful = docs.where(F.coalesce(some, F.lit(True)))
    return docs.where(~some).unionAll(doubtful.join(gone, own == F.col(name), "left_anti"))
