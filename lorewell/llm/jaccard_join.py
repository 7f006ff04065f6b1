"""N-gram Jaccard join by PartEnum signatures.

A document's set has the hashes of its distinct k-word shingles.  Sets are banded by size so that
two sets with similarity of the threshold or more lie in the same or adjacent bands; for a pair
whose smaller set is in band j, the symmetric difference has at most K_j elements.  For each band
the feature domain is cut into n1 = K_j // 2 + 1 + SPARE first-level parts of three second-level
parts each: at least 1 + SPARE first-level parts differ in one element at most, so there two of the
three second-level parts agree.  Every such subset of two is one signature, and linked sets share
one.  A subset without elements says nothing and is left out, which is safe for a set with at most
SPARE first-level parts that have such subsets; other sets send all.  Where K_j is 1, the signatures
are the set and the set without each one element; where it is 0, the set itself.

A set is a node, told by a 64-bit hash of it, so exact copies are one node from the start.
Signatures join in hash ranges: a task sends each signature and set once, both shortened to the bits that tell
most of them apart, and a range gives the
groups of sets that share a signature, each distinct group once.  A group of more than `split_rows` sets
may share no more than a passage, so its sets meet anew, by their rare elements.  Elements have an order,
the rare ones of those sets first; linked sets differ in so few elements that the first ones of each, one
more than may be missing, have one in common.  Sets of a group are compared by
sketches: the parities of their elements' counts in hashed cells.  An element that only one of two
sets has changes one cell, so sketches differ in no more cells than the sets have elements apart, and
a pair whose sketches differ in more than linked sets may isn't linked.  Sketches are folded no further than
the smaller set of a pair needs: a sketch of far fewer cells than elements differs from any other in half of
its cells, and says nothing.  What is left of the pairs is
nearly all true; its components are clusters, and each cluster's texts meet once to be compared
exactly.  Groups of more than `group_rows` sets are dealt into blocks, each pair of which is compared,
and clusters of more than `cluster_bytes` of text by size band and then likewise, so every task is
bounded and no pair is left out.

Defined cases: texts with fewer than k words have one shingle, the whole sequence; null, empty and
wordless texts have an empty set and no links; documents without an id are linked with nothing and
have no component; rows with equal ids are one node, whatever their texts; an empty table gives an
empty result; other columns are not looked at.  Ids must be whole numbers.  Shingles and sets are
told apart by 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import support
from .columnar import U, WORD_BASE, Words, mix, pack, pieces, ranged, runs, running, texts, unpack
from .components import components
from .support import blocks_for, bounded, materialised, text_bytes

SPARE = 2
#: Bytes of text whose signatures make one hash range; ranges grow with the root of the input, eightfold at most.
RANGE_BYTES = 4 << 20
#: Signatures that are held before they are sent.
HELD = 500_000
#: Cells of a sketch, at least and at most.
CELLS = (64, 1 << 15)
#: Rows of groups, and bytes of clusters' texts, that one task compares at once.
LOT_ROWS, LOT_BYTES = 20_000, 4 << 20
#: Cells of the table that tells how common an element is, by its high bits: a byte each.
COMMON_CELLS = 1 << 20
#: Bits that keys have beyond those of their number, and sets beyond those of theirs: a false match only costs a comparison.
KEY_BITS, SET_BITS = 12, 8
_PAIRS = ((0, 1), (0, 2), (1, 2))


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, distinct and ascending within each, and n + 1 offsets."""
    at, h = words.windows(k)
    of = words.text[at]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        sums = running(words.hash, WORD_BASE)
        whole = mix(ranged(sums, words.first[short], words.first[short + 1], WORD_BASE) + words.count[short].astype(U))
        h, of = np.concatenate([h, whole]), np.concatenate([of, short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
        h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(len(words.count) + 1))


def sets_of(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets() of a column of texts, piece by piece, so that memory follows the sets."""
    rows = pa.table({"t": column})
    parts = [shingle_sets(Words(*texts(rows.column("t").slice(a, b - a)), lower=True), k) for a, b in pieces(rows, "t")]
    if not parts:
        return np.zeros(0, U), np.zeros(1, np.int64)
    return np.concatenate([h for h, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in parts]))])


def bands(most: int, num: int, den: int) -> list[tuple[int, int]]:
    """Size bands [l, u] up to `most`, with u = l / threshold, for the threshold num / den."""
    out, low = [], 1
    while low <= most:
        high = low * den // num
        out.append((low, high))
        low = high + 1
    return out


def signatures(h: np.ndarray, offsets: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets, and the set that each belongs to."""
    size = np.diff(offsets)
    if not len(h):
        return np.zeros(0, U), np.zeros(0, np.int64)
    cut = bands(int(size.max()), num, den)
    low = np.array([a for a, _ in cut])
    differ = np.array([b * (den - num) // num for _, b in cut])
    band = np.searchsorted(low, size, "right") - 1
    sigs, sets = [], []
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(h), dtype=U)])
    for back in (0, 1):  # as the smaller set's band, or the one below it
        tag = band - back
        rows = np.flatnonzero((size > 0) & (tag >= 0))
        most = differ[tag[rows]]
        salt = lambda r: mix((tag[r] + 1).astype(U) * U(0x9E3779B97F4A7C15))
        few = rows[most <= 1]
        sigs.append(mix((sums[offsets[few + 1]] - sums[offsets[few]]) ^ salt(few)))
        sets.append(few)
        one = rows[most == 1]
        if len(one):  # the set without each one element
            of = np.repeat(one, size[one])
            each = _flat(offsets, one)
            sigs.append(mix((sums[offsets[of + 1]] - sums[offsets[of]] - mix(h[each])) ^ salt(of)))
            sets.append(of)
        many = rows[most > 1]
        if len(many):
            n1 = differ[tag[many]] // 2 + 1 + SPARE
            base = np.concatenate([[0], np.cumsum(3 * n1)])
            of = np.repeat(np.arange(len(many)), size[many])
            each = h[_flat(offsets, many)]
            part = base[of] + (mix(each ^ salt(many)[of]) % (3 * n1[of]).astype(U)).astype(np.int64)
            total, count = np.zeros(base[-1], U), np.bincount(part, minlength=base[-1])
            np.add.at(total, part, mix(each))
            total, count = total.reshape(-1, 3), count.reshape(-1, 3)
            owner = np.repeat(np.arange(len(many)), n1)
            first = np.arange(len(owner)) - np.repeat(base[:-1] // 3, n1)
            hollow = (count > 0).sum(1) < 2
            send_all = np.bincount(owner, hollow, len(many)) > SPARE
            for k, (x, y) in enumerate(_PAIRS):
                ok = (count[:, x] + count[:, y] > 0) | send_all[owner]
                key = mix(total[ok, x] + U(k + 1)) + U(3) * mix(total[ok, y] ^ U(0xABCD)) + mix(first[ok].astype(U) * U(4) + U(k))
                sigs.append(mix(key ^ salt(many)[owner[ok]]))
                sets.append(many[owner[ok]])
    return np.concatenate(sigs), np.concatenate(sets)


def _flat(offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The element positions of some sets, one set after another."""
    size = offsets[rows + 1] - offsets[rows]
    skip = np.repeat(offsets[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return np.arange(int(size.sum())) + skip


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a-b: (smallest node, other node)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = flat[: len(a)], flat[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def set_hashes(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(h), dtype=U)])
    return mix(sums[offsets[1:]] - sums[offsets[:-1]]) ^ np.diff(offsets).astype(U)


def sketches(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of sets, as bytes and n + 1 offsets.  A set of n elements has the next power
    of two of cells, CELLS[0] at least and CELLS[1] at most; halves of a sketch fold by exclusive or."""
    size = np.diff(offsets)
    cells = np.clip(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), *CELLS)
    base = np.concatenate([[0], np.cumsum(cells)])
    at = np.repeat(base[:-1], size) + (h & np.repeat(cells - 1, size).astype(U)).astype(np.int64)
    odd = (np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little"), base // 8


def _folded(rows: list[bytes]) -> np.ndarray:
    """Sketches of one length, that of the shortest, as rows of 64-bit numbers."""
    short = min(map(len, rows))
    out = np.empty((len(rows), short // 8), U)
    for i, x in enumerate(rows):
        part = np.frombuffer(x, U)
        out[i] = part if len(x) == short else np.bitwise_xor.reduce(part.reshape(-1, short // 8))
    return out


def alike(size: np.ndarray, rows: list[bytes], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of sets that connect every two sets which their sizes and sketches allow to be
    linked: every pair of a few sets, and of many those that aren't connected already.  The sketches of a pair
    are folded to the length of the shorter one, whatever others there are."""
    length, label, a, b = np.array([len(x) for x in rows]), np.arange(len(rows)), [], []
    for short in np.unique(length).tolist():
        own = np.flatnonzero(length == short)
        some = np.concatenate([own, np.flatnonzero((length > short) & (num * size <= den * size[own].max()))])
        m, flat, n = len(own), _folded([rows[i] for i in some.tolist()]), size[some]
        near = lambda i, j: den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])  # noqa: B023, E731
        fits = lambda i, j: (den + num) * np.bitwise_count(flat[i] ^ flat[j]).sum(-1, dtype=np.int64) <= (den - num) * (n[i] + n[j])  # noqa: B023, E731
        if len(some) ** 2 * flat.shape[1] <= 1 << 20:
            i, j = np.triu_indices(len(some), 1)
            ok = (i < m) & near(i, j)
            i, j = i[ok], j[ok]
            ok = fits(i, j)
            a += some[i[ok]].tolist()
            b += some[j[ok]].tolist()
            continue
        for i in range(m):
            later = i + 1 + np.flatnonzero(label[some[i + 1 :]] != label[some[i]])
            later = later[near(i, later)]
            for c in range(0, len(later), 1000):
                found = later[c : c + 1000]
                found = some[found[fits(i, found)]]
                a += [some[i]] * len(found)
                b += found.tolist()
                label[np.isin(label, label[found])] = label[some[i]]
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    return np.minimum(x, y), np.maximum(x, y)


def shingle_table(docs: DataFrame, doc: str, text: str, k: int) -> DataFrame:
    """(d, w, n, bytes, s) of every row: id, hash of the set, its size, the text's bytes and the sketch."""
    rows = docs.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t"))

    def made(batches):
        for batch in batches:
            for i, j in pieces(batch, "t"):
                part = batch.slice(i, j - i)
                buf, at = texts(part.column("t"))
                h, offsets = shingle_sets(Words(buf, at, lower=True), k)
                flat, cut = sketches(h, offsets)
                s = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_pydict({"d": part.column("d"), "w": pa.array(set_hashes(h, offsets).view(np.int64)), "n": pa.array(np.diff(offsets).astype(np.int64)), "bytes": pa.array(np.diff(at)), "s": s})

    return rows.mapInArrow(made, "d long, w long, n long, bytes long, s binary")


def shingle_counts(docs: DataFrame, doc: str, text: str, k: int) -> DataFrame:
    """(doc_id, n_shingles) of every row."""
    return shingle_table(docs, doc, text, k).select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"))


def _dropped(bits: int) -> int:
    """Low bits of a 64-bit hash that go if `bits` are to stay: whole bytes, since these are what pack() saves."""
    return max(0, 64 - bits) // 8 * 8


def _ranges(total: int) -> U:
    """By how many bits hashes are shifted to tell their range, for so many bytes of text."""
    return U(64 - max(1, (blocks_for(total, RANGE_BYTES, 8 * RANGE_BYTES) - 1).bit_length()))


def _sent(keys: np.ndarray, other: np.ndarray, shift: U) -> pa.RecordBatch:
    """(r, p): ascending keys and what belongs to them, packed by range."""
    at = runs(keys >> shift)
    cut = [*at, len(keys)]
    p = [pack(keys[i:j], other[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
    return pa.RecordBatch.from_pydict({"r": pa.array((keys[at] >> shift).astype(np.int32)), "p": pa.array(p, pa.binary())})


def _got(x: pa.Table) -> list[np.ndarray]:
    """The columns that _sent() has packed."""
    return [np.concatenate(c) for c in zip(*(unpack(p, 2) for p in x.column("p").to_pylist()), strict=True)]


def _in_lots(batches, k: int, made, merged, shift: U):
    """_sent() of what made(h, offsets) gives for the sets of the texts t, merged for some HELD keys."""
    held = []
    for batch in batches:
        for i, j in pieces(batch, "t"):
            held.append(made(*shingle_sets(Words(*texts(batch.column("t").slice(i, j - i)), lower=True), k)))
            if sum(len(x[0]) for x in held) >= HELD:
                yield _sent(*merged(*(np.concatenate(x) for x in zip(*held, strict=True))), shift)
                held = []
    if held:
        yield _sent(*merged(*(np.concatenate(x) for x in zip(*held, strict=True))), shift)


def key_groups(rows: DataFrame, total: int, k: int, keys_of, cut: int) -> DataFrame:
    """(g, w): the sets w, without their `cut` low bits, that share a key are a group g; each group of sets is there
    once.  keys_of(h, offsets) gives keys of sets and the set that each belongs to; rows has texts t, of `total` bytes
    at most."""
    shift, spare, low = _ranges(total), U(_dropped(max(1, total // 8).bit_length() + KEY_BITS)), U(cut)

    def made(h, offsets):
        w = set_hashes(h, offsets)
        some = np.flatnonzero(np.diff(offsets) > 0)
        some = some[np.unique(w[some], return_index=True)[1]]
        if not len(some):
            return h, w[some]
        keys, of = keys_of(*_some(h, offsets, some))
        return keys >> spare << spare, w[some][of] >> low << low

    def grouped(x: pa.Table) -> pa.Table:
        keys, sets = _pairs(*_got(x))
        at = runs(keys)
        size = np.diff(np.append(at, len(keys)))
        name = mix(np.add.reduceat(mix(sets + U(1)), at)) if len(at) else keys
        at, size, name = at[size > 1], size[size > 1], name[size > 1]
        name, first = np.unique(name, return_index=True)
        at, size = at[first], size[first]
        skip = np.repeat(at - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(at) else at
        return pa.table({"g": pa.array(np.repeat(name, size).view(np.int64)), "w": pa.array(sets[np.arange(int(size.sum())) + skip].view(np.int64))})

    return rows.mapInArrow(lambda batches: _in_lots(batches, k, made, _pairs, shift), "r int, p binary").groupBy("r").applyInArrow(grouped, "g long, w long").distinct()


def candidate_groups(docs: DataFrame, text: str, k: int, num: int, den: int, cut: int = 0) -> DataFrame:
    """key_groups() by signatures."""
    return key_groups(docs.select(F.col(text).alias("t")), text_bytes(docs, text), k, lambda h, offsets: signatures(h, offsets, num, den), cut)


def _pairs(keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, in order."""
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])
    return keys[new], sets[new]


def _cells(h: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each element, by its high bits; cells is a power of two."""
    return (h >> U(65 - cells.bit_length())).astype(np.int64)


def first_elements(h: np.ndarray, offsets: np.ndarray, common: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The first elements of sets and the set that each belongs to.  Elements are in the order of (their cell
    of `common`, hash), whatever `common` is: of n elements num * n / den are shared with a linked set at least,
    so that n - num * n / den + 1 of them reach one that is shared, and the first shared one is the same for both."""
    size = np.diff(offsets)
    of = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((h, common[_cells(h, len(common))], of))
    place = np.arange(len(h)) - np.repeat(offsets[:-1], size)
    some = place <= np.repeat(size - -(-num * size // den), size)
    return h[order][some], of[some]


def common_elements(rows: DataFrame, total: int, k: int, least: int) -> np.ndarray:
    """The level, log2 of the number of sets, of the most common element of each of COMMON_CELLS cells, of those in more than
    `least` sets.  Elements are counted without their low bits; one that is taken for another is said to be more common."""
    shift, spare = _ranges(total), U(_dropped(max(1 << 31, total // 8).bit_length()))

    def merged(keys, n):
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        at = runs(keys)
        return (keys[at], np.add.reduceat(n, at)) if len(at) else (keys, n)

    def counted(x: pa.Table) -> pa.Table:
        keys, n = merged(*_got(x))
        cell, level = _cells(keys[n > U(least)], COMMON_CELLS), np.log2(n[n > U(least)]).astype(np.int32)
        at = runs(cell)
        return pa.table({"cell": pa.array(cell[at].astype(np.int32)), "level": pa.array(np.maximum.reduceat(level, at) if len(at) else level)})

    made = lambda h, offsets: (h >> spare << spare, np.ones(len(h), U))
    cells = rows.mapInArrow(lambda batches: _in_lots(batches, k, made, merged, shift), "r int, p binary").groupBy("r").applyInArrow(counted, "cell int, level int")
    cells = cells.groupBy("cell").agg(F.max("level").alias("level")).toArrow()
    common = np.zeros(COMMON_CELLS, np.uint8)
    common[cells.column("cell").to_numpy()] = cells.column("level").to_numpy()
    return common


def split_groups(docs: DataFrame, nodes: DataFrame, groups: DataFrame, doc: str, text: str, k: int, num: int, den: int, split_rows: int, cut: int = 0) -> DataFrame:
    """groups with those of more than split_rows sets replaced: their sets are grouped by their first elements.
    Of groups of the same sets one is left.  Only a table of COMMON_CELLS cells goes to the driver.  If the sets
    are too many to be broadcast, all sets are grouped by their first elements: that adds candidates, and costs less than
    to deal out all texts.  Elements are made anew from the texts for each pass; on disk they would be as large as these."""
    large = materialised(groups.groupBy("g").count().filter(F.col("count") > split_rows).select("g"), "large-groups")
    if not large.count():
        return groups
    large = bounded(large)
    again = materialised(groups.join(large, "g", "left_semi").select("w").distinct().join(nodes.select("w", "r"), "w").select(F.col("r").alias("node")).distinct(), "sets-of-large-groups")
    rows = docs.filter(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("node"), F.col(text).alias("t"))
    if again.count() <= support.BROADCAST_ROWS:
        rows = rows.join(F.broadcast(again), "node", "left_semi")
    rows, total = rows.select("t"), text_bytes(docs, text)
    common = common_elements(rows, total, k, split_rows)
    found = key_groups(rows, total, k, lambda h, offsets: first_elements(h, offsets, common, num, den), cut)
    return materialised(groups.join(large, "g", "left_anti").unionByName(found).distinct(), "split-groups")


def candidate_links(nodes: DataFrame, groups: DataFrame, num: int, den: int, group_rows: int) -> DataFrame:
    """Links (a, b) that connect every two sets of a group that sizes and sketches allow to be linked.
    nodes has (w, r, n, s), and links are between the sets' documents r."""
    large = bounded(materialised(groups.groupBy("g").count().filter(F.col("count") > group_rows).select("g", F.ceil(2 * F.col("count") / group_rows).cast("int").alias("blocks")), "large-groups"))
    dealt = groups.join(large, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("w"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "w")
    lots = max(1, -(-dealt.count() // LOT_ROWS))
    rows = dealt.join(nodes, "w").select("g", "r", "n", "s", F.pmod("g", F.lit(lots)).cast("int").alias("lot"))

    def compared(x: pa.Table) -> pa.Table:
        g = x.column("g").to_numpy()
        order = np.argsort(g, kind="stable")
        r, n, s = x.column("r").to_numpy()[order], x.column("n").to_numpy()[order], x.column("s").take(pa.array(order)).to_pylist()
        at = [*runs(g[order]).tolist(), len(g)]
        found = [(r[i:j][a], r[i:j][b]) for i, j in zip(at, at[1:], strict=False) if j > i + 1 for a, b in [alike(n[i:j], s[i:j], num, den)]]
        a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (r[:0], r[:0])
        a, b = _forest(a, b) if len(a) else (a, b)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("lot").applyInArrow(compared, "a long, b long")


def _some(h: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h[_flat(offsets, rows)], np.concatenate([[0], np.cumsum(offsets[rows + 1] - offsets[rows])])


def exact_links(ids: np.ndarray, h: np.ndarray, offsets: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect every two sets whose similarity reaches num / den, directly or by others: a
    set is compared with the later ones that aren't connected with it yet, of many sets with those
    that share a signature."""
    rows = np.flatnonzero(np.diff(offsets) > 0)
    h = np.unique(_some(h, offsets, rows)[0], return_inverse=True)[1]
    size = np.diff(offsets)[rows]
    offsets = np.concatenate([[0], np.cumsum(size)])
    many = len(rows) > 64
    if many:
        sig, of = signatures(h.astype(U), offsets, num, den)
        order = np.lexsort((of, sig))
        start = runs(sig[order])
        members, lot = of[order], np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        start = np.append(start, len(order))
        own = np.argsort(members, kind="stable")
        first = np.searchsorted(members[own], np.arange(len(rows) + 1))
    label, mark, found = np.arange(len(rows)), np.zeros(h.max(initial=-1) + 1, bool), []
    with_label = {i: [i] for i in range(len(rows))}
    for i in range(len(rows) - 1):
        if many:
            lots = lot[own[first[i] : first[i + 1]]]
            lots = lots[start[lots + 1] - start[lots] > 1]
            later = np.unique(members[_flat(start, lots)]) if len(lots) else lots
            later = later[later > i]
        else:
            later = np.arange(i + 1, len(rows))
        later = later[(label[later] != label[i]) & (den * np.minimum(size[later], size[i]) >= num * np.maximum(size[later], size[i]))]
        for c in range(0, len(later), 2000):
            some = later[c : c + 2000]
            mark[h[offsets[i] : offsets[i + 1]]] = True
            hit = mark[h[_flat(offsets, some)]]
            mark[h[offsets[i] : offsets[i + 1]]] = False
            both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(size[some])[:-1]]))
            for j in some[den * both >= num * (size[some] + size[i] - both)].tolist():
                if label[j] == label[i]:
                    continue
                found.append((i, j))
                few, more = sorted((int(label[i]), int(label[j])), key=lambda x: len(with_label[x]))
                label[with_label[few]] = more
                with_label[more] += with_label.pop(few)
    x, y = np.array(found, np.int64).reshape(-1, 2).T
    return _forest(ids[rows[x]], ids[rows[y]]) if found else (ids[:0], ids[:0])


def linked_sets(docs: DataFrame, table: DataFrame, doc: str, text: str, k: int, num: int, den: int, cluster_bytes: int, group_rows: int, split_rows: int) -> DataFrame:
    """(w, component) of the sets of a shingle_table() that have a link or are in more than one document."""
    own = table.filter(F.col("d").isNotNull() & (F.col("n") > 0))
    nodes = own.groupBy("w").agg(F.min("d").alias("r"), F.max("d").alias("last"), F.first("n").alias("n"), F.first("bytes").alias("bytes"), F.first("s").alias("s"))
    cut = _dropped(table.count().bit_length() + SET_BITS)  # two sets that look alike then are both in the groups of either
    short = nodes.select(F.shiftleft(F.shiftright("w", cut), cut).alias("w"), "r", "n", "s")
    groups = materialised(candidate_groups(docs.filter(F.col(doc).isNotNull()), text, k, num, den, cut), "signature-groups")
    groups = split_groups(docs, short, groups, doc, text, k, num, den, split_rows, cut)
    near = candidate_links(short, groups, num, den, group_rows)
    clusters = materialised(components(near), "clusters")
    band = F.floor(F.log("n") / F.log(F.lit(1.001 * den / num))).cast("int")  # linked sets are in one or in adjacent ones
    members = materialised(nodes.select(F.col("r").alias("node"), "bytes", band.alias("band")).join(bounded(clusters), "node"), "members")
    dealt = materialised(_dealt(members, cluster_bytes), "cluster-lots")
    lots = max(1, -(-(dealt.agg(F.sum("bytes")).first()[0] or 0) // LOT_BYTES))
    dealt = bounded(dealt.select("node", "lot", F.pmod("lot", F.lit(lots)).cast("int").alias("task")).distinct())
    rows = docs.filter(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("node"), F.col(text).alias("t")).join(dealt, "node")

    def compared(x: pa.Table) -> pa.Table:
        x = x.sort_by("lot")
        h, offsets = sets_of(x.column("t"), k)
        node, found = x.column("node").to_numpy(), []
        at = [*runs(x.column("lot").to_numpy()).tolist(), x.num_rows]
        for i, j in zip(at, at[1:], strict=False):
            if j > i + 1:
                found.append(exact_links(node[i:j], h[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], num, den))
        a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (node[:0], node[:0])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = rows.groupBy("task").applyInArrow(compared, "a long, b long")
    twice = materialised(own.groupBy("d").agg(F.min("w").alias("x"), F.max("w").alias("y")).filter("x <> y").select("d"), "repeated-ids")
    if twice.count():  # rows with equal ids and different sets
        same = own.join(bounded(twice), "d").select("d", "w").distinct().join(nodes.select("w", "r"), "w")
        links = links.unionByName(same.groupBy("d").agg(F.min("r").alias("a")).join(same.select("d", F.col("r").alias("b")), "d").select("a", "b"))
    found = components(links)
    last = nodes.select("w", "r", "last").join(bounded(materialised(found, "components")).withColumnRenamed("node", "r"), "r", "left")
    return last.filter(F.col("component").isNotNull() | (F.col("r") < F.col("last"))).select("w", F.coalesce("component", "r").alias("component"))


def _dealt(members: DataFrame, most: int) -> DataFrame:
    """(node, bytes, lot): the lots that members are compared in.  A cluster of at most `most` bytes is
    one lot.  A larger one is dealt by size band, a member to its own band and the one below, since
    linked sets are in the same or adjacent bands; and a band that is still larger into blocks, each
    pair of which is a lot."""
    whole = members.groupBy("component").agg((F.sum("bytes") > most).alias("large"))
    lots = members.join(whole, "component")
    lots = lots.withColumn("band", F.explode(F.when(F.col("large"), F.array(F.col("band"), F.col("band") - 1)).otherwise(F.array(F.lit(-9)))))
    sizes = lots.groupBy("component", "band").agg(F.greatest(F.lit(1), F.ceil(F.sum("bytes") / F.lit(most))).cast("int").alias("n"))
    lots = lots.join(sizes, ["component", "band"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    lots = lots.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return lots.select("node", "bytes", F.xxhash64("component", "band", F.least("own", "other"), F.greatest("own", "other")).alias("lot"))


def _table(docs: DataFrame, doc: str, text: str, k: int) -> DataFrame:
    return materialised(shingle_table(docs, doc, text, k), "shingle-sets")


def jaccard_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100, cluster_bytes: int = 8 << 20, group_rows: int = 1000, split_rows: int = 100) -> DataFrame:
    """(node, component) of the documents that have a link: two documents link when den times the
    size of their sets' intersection is num times the size of their union, or more."""
    table = _table(docs, doc, text, k)
    found = bounded(materialised(linked_sets(docs, table, doc, text, k, num, den, cluster_bytes, group_rows, split_rows), "linked-sets"))
    return table.filter(F.col("d").isNotNull()).select("d", "w").join(found, "w").select(F.col("d").alias("node"), "component").distinct()


def jaccard_join(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100, cluster_bytes: int = 8 << 20, group_rows: int = 1000, split_rows: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    table = _table(docs, doc, text, k)
    found = bounded(materialised(linked_sets(docs, table, doc, text, k, num, den, cluster_bytes, group_rows, split_rows), "linked-sets"))
    own = F.when(F.col("d").isNotNull(), F.coalesce("component", "d"))
    return table.select("d", "w", "n").join(found, "w", "left").select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"))


def op6_query(spark, sf_dir):
    from .support import table

    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, num=90, den=100)


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+2], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
q AS (SELECT s.doc_id, s.g FROM s JOIN rare USING (g)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM q a JOIN q b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 90 * (nx.n + ny.n - k)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT b.y, r.root FROM r JOIN both_ways b ON b.x = r.node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node) c USING (doc_id)
"""
