"""LM scoring: a causal self-attention model in numpy over subword ids with a memory of the corpus, and a unigram baseline over words.

Words (lower-cased in A-Z) become ids of a public byte-level vocabulary, each word with a space before it, and a text ends
with the vocabulary's end id. The attention model gives every id a probability in two factors: of its class given the
context, and of the id within its class (corpus counts, half added to each). The most frequent ids are classes of
their own; the others are classed by their neighbours.

The class given the context: logits are the log of class-bigram probabilities (corpus counts) plus what one head of causal
self-attention with relative positions adds. What it adds is the same for the classes of one of SETS sets, which are made of classes with like
neighbours, so the sum over all classes is one over the sets, whose bigram sums are kept. Texts are cut into overlapping windows; a window scores only the positions
after its overlap, so each token is scored once, with at least OVERLAP tokens of context; windows are
batched and masked.

Two kinds of corpus counts are mixed in, with every text's own occurrence left out (one is subtracted for rows that were
learnt), so that learnt and held-out rows are on one scale:

* words: a word's probability is a part (of MIXES, that under which the learnt texts are likeliest) of its share in the training tokens, and the rest from the attention
  model. Tasks hold the counts of words with a share of at least 2 ** -LISTED_BITS (so at most 2 ** LISTED_BITS words, whatever the corpus); all others meet theirs in a join by word;
* passages: words are cut to chunks after every word whose hash is 0 modulo CHUNK_WORDS, so the cuts follow the content; the
  probability of a chunk after the one before it is a part ``kept`` of its discounted share among the chunks that followed that one
  in the corpus, and 1 - kept of the product of its words' probabilities. A text that occurs elsewhere is so told from one that does not.

Scores are log probabilities of a model whose sum over texts is at most one (what the discounts free is not given away).

Learning. Everything is learnt from all training texts, and what reaches the driver has a fixed size but for the listed words. One
pass over the texts counts words, pairs of neighbouring ids and pairs of chunks, and lays down the windows of ids by ROUNDS rounds (the round of a window
follows from its text and place). Classes, their sets and the class bigram follow from the pairs of ids. The attention takes one step of Adam
for each round, by the gradient over all of its windows, so each token is trained on once. Scoring tells every sum for each of MIXES,
and the part is chosen by the sums of the learnt rows. Nothing depends on the number of tasks; sums of floats may differ in their last digits.

Null is the empty text: one end token. Without training rows the model is uniform and the baseline has N = 0 and V = 0.
Rows are scored row by row, so repeated rows and ids are no matter. Only doc_id and text are read: other columns may have any name.
"""

from __future__ import annotations

import base64
import math
import uuid
from array import array
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import crc_mod, prepare, scratch_path, stored, words_of

WINDOW, OVERLAP = 24, 6
DIM, OWN, GROUPS, SETS = 8, 112, 48, 16
CLASSES = OWN + GROUPS
#: The model is made from so many training texts: None is all of them.
START_DOCS = None
#: Steps of training, and the rate of the first.
ROUNDS, RATE = 32, 0.2
#: Words with a share of at least 2 ** -LISTED_BITS are listed in tasks; those under 2 ** -SHARE_BITS would have no part in the mixture, and there are none under 2 ** -63.
LISTED_BITS, SHARE_BITS = 21, 63
CHUNK_WORDS = 32
MIXES = (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)
#: Windows scored, and windows trained on at once.
CHUNK, TRAINED = 128, 256
#: Words encoded at once.
AT_ONCE = 4096
#: Entries of remembered words and of partial word counts in a task.
REMEMBERED, PARTIAL = 280_000, 400_000
#: Pairs of ids, and bytes of windows, that a task holds before it hands them on.
PAIRED, LAID = 1_000_000, 16 << 20
END_WORD = b""
_M1, _M2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
#: What stands before a text's first chunk.
BEFORE = np.uint64(0x243F6A8885A308D3)


def load_vocabulary(ranks_file: str) -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    with open(ranks_file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, public_tokenizers.PATTERN


class Subwords:
    """Ids of words: each as it is encoded alone with a space before it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self.begins = np.zeros(self.size, bool)
        self.begins[[k for b, k in ranks.items() if b.startswith(b" ")]] = True

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has.

        Words without white space of any kind are encoded in one call: no piece of the pattern reaches over the space between
        two of them, and an id begins a word exactly if it begins with that space.
        """
        texts = [w.decode("utf-8", "replace") for w in words]
        line = "".join([" " + t for t in texts])
        if len(line.split()) == len(texts):
            ids = np.array(self.encode(line), np.int32)
            first = np.nonzero(self.begins[ids])[0]
            if len(first) == len(texts):
                return ids, np.diff(first, append=len(ids))
        each = [self.encode(" " + t) for t in texts]
        return np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64)

    def text(self, words: list[bytes]) -> np.ndarray:
        return np.append(self.many(words)[0], np.int32(self.end)).astype(np.int32) if words else np.array([self.end], np.int32)


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, seed=7)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def chunks(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of texts from the hashes of their words and ends; ``ends`` are the places after each text.

    Places of the chunks' first words, keys of the chunks before, keys of the pairs.
    """
    last = hashes % np.uint64(CHUNK_WORDS) == 0
    last[ends - 1] = True
    first = np.concatenate([[0], np.nonzero(last)[0][:-1] + 1])
    place = np.arange(len(hashes)) - np.repeat(first, np.diff(first, append=len(hashes)))
    key = mixed_bits(np.add.reduceat(hashes * (place.astype(np.uint64) * _STEP + np.uint64(1)), first))
    before = np.concatenate([[BEFORE], key[:-1]])
    before[np.searchsorted(first, ends[:-1])] = BEFORE
    return first, before, mixed_bits(before * _STEP + key)


class Numbered(dict):
    """Numbers of words in order of their first occurrence, and by number their ids, hash and listed count: one look-up tells all."""

    def __init__(self, sub: Subwords, top: dict[bytes, int] | None = None):
        super().__init__()
        self.sub, self.top, self.new = sub, top or {}, []
        self[END_WORD] = 0
        self.flat, self.size = np.array([sub.end], np.int32), np.ones(1, np.int64)
        self.hash, self.count = np.array([word_hash(END_WORD)], np.uint64), np.array([self.top.get(END_WORD, 0)], np.int64)
        self.at = np.zeros(1, np.int64)
        #: First and last id of each word.
        self.ends = np.stack([self.flat, self.flat])

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        k = self[word] = len(self)
        return k

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words and of the end."""
        return np.fromiter(map(self.__getitem__, chain(words, (END_WORD,))), np.int64, len(words) + 1)

    def arranged(self) -> None:
        """Brings the arrays up to date: new words are encoded many at a time."""
        if not self.new:
            return
        made = [self.sub.many(self.new[lo : lo + AT_ONCE]) for lo in range(0, len(self.new), AT_ONCE)]
        get = self.top.get
        self.hash = np.concatenate([self.hash, np.array(list(map(word_hash, self.new)), np.uint64)])
        self.count = np.concatenate([self.count, np.array([get(w, 0) for w in self.new], np.int64)])
        self.flat = np.concatenate([self.flat, *[ids for ids, _ in made]])
        self.size = np.concatenate([self.size, *[n for _, n in made]])
        self.at = np.cumsum(self.size) - self.size
        self.ends = np.stack([self.flat[self.at], self.flat[self.at + self.size - 1]])
        self.new.clear()

    def streams(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of numbered words, and how many each has."""
        size = self.size[numbers]
        before = np.cumsum(size) - size
        return self.flat[np.arange(int(size.sum())) + np.repeat(self.at[numbers] - before, size)], size


def memory_kept() -> None:
    """After a large block was given back, glibc keeps the memory of arrays below its size: else each batch of windows takes and clears new pages."""
    np.empty(24 << 20, np.uint8)


_TABLES: dict = {}


def remembered(kind: str, key: str, make):
    """One table of each kind for each worker process, kept between tasks of one model."""
    if _TABLES.get(kind, ("", None))[0] != key:
        _TABLES[kind] = (key, make())
    return _TABLES[kind][1]


# -- the network


def start_weights(seed: int = 3) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    n = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
    return {
        "q": n(CLASSES + 1, DIM), "k": n(CLASSES + 1, DIM), "v": n(CLASSES + 1, DIM),
        "rel": np.linspace(0.5, -1.0, WINDOW).astype(np.float32), "u": np.zeros((DIM, SETS), np.float32), "b": np.zeros(CLASSES, np.float32),
    }


_DISTANCE = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
_FUTURE = np.where(_DISTANCE < 0, np.float32(-1e9), np.float32(0))
_DISTANCE = np.maximum(_DISTANCE, 0)


def looked_up(w: dict) -> np.ndarray:
    """By class, what is looked up at once: q with its scale, k, v and a one, whose sum is that of the weights of v."""
    return np.concatenate([w["q"] * np.float32(DIM**-0.5), w["k"], w["v"], np.ones_like(w["v"][:, :1])], axis=1)


def highest(table: np.ndarray, place: np.ndarray) -> float:
    return float((table[:, :DIM] @ table[:, DIM : 2 * DIM].T).max() + place.max())


class Scorer:
    """The trained network arranged for scoring: scales folded in, the bigram as factors, summed by sets."""

    def __init__(self, w: dict, bigram: np.ndarray, sets: np.ndarray):
        self.table, self.u, self.sets = looked_up(w), w["u"], sets
        self.place = w["rel"][_DISTANCE] + _FUTURE
        self.high = highest(self.table, self.place) > 30
        self.bigram = bigram + w["b"]
        self.factor = np.exp(self.bigram) @ one_hot(sets)

    def log_probabilities(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of the target classes y of the positions after the overlap of each window."""
        t = np.take(self.table, x, axis=0)
        s = t[:, OVERLAP:, :DIM] @ t[:, :, DIM : 2 * DIM].transpose(0, 2, 1)
        s += self.place[OVERLAP:]
        if self.high:
            np.minimum(s, np.float32(30), out=s)
        np.exp(s, out=s)
        o = (s @ t[:, :, 2 * DIM :]).reshape(-1, DIM + 1)
        o = o[:, :DIM] / o[:, DIM:]
        np.tanh(o, out=o)
        x, y = x[:, OVERLAP:].reshape(-1), y[:, OVERLAP:].reshape(-1)
        logits = o @ self.u
        target = logits[np.arange(len(y)), self.sets[y]] + self.bigram[x, y]
        np.exp(logits, out=logits)
        return target - np.log(np.einsum("ij,ij->i", logits, self.factor[x]))


def one_hot(sets: np.ndarray) -> np.ndarray:
    return (sets[:, None] == np.arange(SETS)).astype(np.float32)


def sums_by(x: np.ndarray, z: np.ndarray, n: int) -> np.ndarray:
    """Sums (n, columns) of the rows of z with equal x."""
    return np.stack([np.bincount(x, column, n) for column in z.reshape(len(x), -1).T.astype(np.float64, order="C")], axis=1)


def gradients(w: dict, bigram: np.ndarray, sets: np.ndarray, x: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[dict, float]:
    """Gradients of the mean negative log likelihood over positions ``on``, and its value.

    Probabilities are summed by sets, as in Scorer; positions before the first that is on anywhere are context only.
    """
    lo, n = int(on.any(axis=0).argmax()), max(1, int(on.sum()))
    scale, place = np.float32(DIM**-0.5), (w["rel"][_DISTANCE] + _FUTURE)[lo:]
    table = looked_up(w)
    t = np.take(table, x, axis=0)
    q, k, v = t[:, lo:, :DIM], t[:, :, DIM : 2 * DIM], t[:, :, 2 * DIM : 3 * DIM]
    s = q @ k.transpose(0, 2, 1)
    s += place
    if highest(table, place) > 30:
        np.minimum(s, np.float32(30), out=s)
    np.exp(s, out=s)
    s /= (s.reshape(-1, WINDOW) @ np.ones(WINDOW, s.dtype)).reshape(*s.shape[:2], 1)
    o = s @ v
    h = np.tanh(o)
    at, y, on = x[:, lo:].ravel(), y[:, lo:].ravel(), on[:, lo:].ravel()
    logits = h.reshape(-1, DIM) @ w["u"]
    total = bigram + w["b"]
    each, target, rows = np.exp(total), sets[y], np.arange(len(y))
    loss = logits[rows, target] + total[at, y]
    np.exp(logits, out=logits)
    p = np.take(each @ one_hot(sets), at, axis=0)
    p *= logits
    z = p @ np.ones(SETS, p.dtype)
    loss = -float((loss - np.log(z)) @ on) / n
    z = on / (n * z)
    p *= z[:, None]
    p[rows, target] -= on / n
    logits *= z[:, None]
    g = {"u": h.reshape(-1, DIM).T @ p, "b": (each * sums_by(at, logits, CLASSES + 1)[:, sets]).sum(axis=0) - np.bincount(y, on, CLASSES) / n}
    do = (p @ w["u"].T).reshape(h.shape)
    do *= 1 - h * h
    ds = do @ v.transpose(0, 2, 1)
    ds -= np.einsum("nij,nij->ni", do, o)[:, :, None]
    ds *= s
    g["rel"] = np.bincount(_DISTANCE[lo:].ravel(), (ds.sum(axis=0) * (_FUTURE[lo:] == 0)).ravel(), WINDOW)
    g["q"] = sums_by(at, ds @ k, CLASSES + 1) * scale
    g["k"] = sums_by(x.ravel(), ds.transpose(0, 2, 1) @ q, CLASSES + 1)
    g["v"] = sums_by(x.ravel(), s.transpose(0, 2, 1) @ do, CLASSES + 1)
    return g, loss


class Adam:
    def __init__(self, w: dict, rate: float = RATE):
        self.rate, self.k = rate, 0
        self.m, self.s = ({n: np.zeros_like(v) for n, v in w.items()} for _ in range(2))

    def step(self, w: dict, g: dict) -> None:
        self.k += 1
        for n in w:
            self.m[n] += 0.1 * (g[n] - self.m[n])
            self.s[n] += 0.01 * (g[n] * g[n] - self.s[n])
            w[n] -= (self.rate * (1 - (self.k - 1) / ROUNDS) * (self.m[n] / (1 - 0.9**self.k)) / (np.sqrt(self.s[n] / (1 - 0.99**self.k)) + 1e-8)).astype(np.float32)


def windows(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (CLASSES stands before the text) and targets of all windows of one text, padded with -1 targets.

    The first window starts at the first token, each later one WINDOW - OVERLAP further; their first OVERLAP positions are
    only context. For one form of all windows, the first is led by OVERLAP copies of the input before the text.
    """
    step = WINDOW - OVERLAP
    n = -(-len(classes) // step)
    x = np.full(n * step + OVERLAP, CLASSES, np.int32)
    y = np.full(n * step + OVERLAP, -1, np.int32)
    x[OVERLAP + 1 : OVERLAP + len(classes)] = classes[:-1]
    y[OVERLAP : OVERLAP + len(classes)] = classes
    at = np.arange(n)[:, None] * step + np.arange(WINDOW)
    return x[at], y[at]


# -- classes and the start


def id_pairs(before: np.ndarray, ids: np.ndarray, n: np.ndarray | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (before * size + id) and how often each occurs; ``size`` stands before a text."""
    key, at = np.unique(before.astype(np.int64) * size + ids, return_inverse=True)
    return key, np.bincount(at, n, len(key)).astype(np.int64)


class Frequent:
    """Ids by falling counts: classes of their own, those to be classed, and those whose nearness tells their class."""

    def __init__(self, counts: np.ndarray):
        size = len(counts)
        order = np.lexsort((np.arange(size), -counts))
        self.own, some, near = order[:OWN], order[OWN : OWN + 3000], order[:256]
        self.some = some[counts[some] > 0]
        #: Row and column in the table of neighbours, -1 for others; the last one is what stands before a text.
        self.row, self.column = np.full(size + 1, -1), np.full(size + 1, -1)
        self.row[self.some], self.column[near] = np.arange(len(self.some)), np.arange(len(near))

    def neighbours(self, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Counts of the pairs by cell: row of an id, column of the near id before it, or 256 on, after it."""
        before, ids = np.divmod(key, len(self.row) - 1)
        out = np.zeros(len(self.some) * 512, np.int64)
        for a, z, shift in ((before, ids, 256), (ids, before, 0)):
            m = (self.row[a] >= 0) & (self.column[z] >= 0)
            out += np.bincount(self.row[a[m]] * 512 + self.column[z[m]] + shift, n[m], len(out)).astype(np.int64)
        return out

    def classed(self, neighbours: np.ndarray) -> np.ndarray:
        """Class of every id: own ones for the most frequent, else by nearest mean of neighbour profiles."""
        out = np.full(len(self.row) - 1, OWN, np.int32)
        out[self.own] = np.arange(OWN)
        if len(self.some) >= GROUPS:
            profile = neighbours.reshape(-1, 512).astype(np.float32)
            out[self.some] = OWN + 1 + clustered(np.sqrt(profile / (profile.sum(axis=1, keepdims=True) + 2)), GROUPS - 1)
        return out


def class_pairs(classes: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts of pairs of classes; CLASSES stands before a text."""
    before, ids = np.divmod(key, len(classes))
    return np.bincount(np.append(classes, CLASSES)[before] * CLASSES + classes[ids], n, (CLASSES + 1) * CLASSES).astype(np.int64)


def clustered(profile: np.ndarray, n: int) -> np.ndarray:
    """The nearest of ``n`` means for each row; the first means are the first rows."""
    r = np.random.default_rng(1)
    means = profile[:n].copy()
    for _ in range(12):
        nearest = (profile @ means.T * 2 - (means**2).sum(axis=1)).argmax(axis=1)
        for g in range(n):
            member = profile[nearest == g]
            means[g] = member.mean(axis=0) if len(member) else profile[r.integers(len(profile))]
    return nearest


def class_sets(pairs: np.ndarray) -> np.ndarray:
    """Set of every class: those with like classes before and after them."""
    pairs = pairs.reshape(CLASSES + 1, CLASSES).astype(np.float32)
    after, before = pairs[:CLASSES], pairs[:CLASSES].T
    share = lambda z: np.sqrt(z / (z.sum(axis=1, keepdims=True) + 2))
    return clustered(np.concatenate([share(after), share(before)], axis=1), SETS)


def log_bigram(pairs: np.ndarray) -> np.ndarray:
    """Log probabilities of the next class, backed off to its share in all pairs."""
    pairs = pairs.reshape(CLASSES + 1, CLASSES).astype(np.float64)
    total = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * CLASSES)
    return np.log((pairs + 20 * total) / (pairs.sum(axis=1, keepdims=True) + 20)).astype(np.float32)


def laid_out(ids: np.ndarray, outside: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a text's ids for training, each with the id after it, and their rounds; ``outside`` stands before and after the text.

    They are those of ``windows``: the targets of a window are its ids one place on.
    """
    step = WINDOW - OVERLAP
    n = -(-len(ids) // step)
    x = np.full(n * step + OVERLAP + 1, outside, np.uint16)
    x[OVERLAP + 1 : OVERLAP + 1 + len(ids)] = ids
    first = xxhash.xxh64_intdigest(ids.astype(np.int32).tobytes(), seed=7) % ROUNDS
    return x[np.arange(n)[:, None] * step + np.arange(WINDOW + 1)], (first + np.arange(n)) % ROUNDS


def gradient_sums(w: dict, bigram: np.ndarray, sets: np.ndarray, classes: np.ndarray, laid: np.ndarray) -> np.ndarray:
    """Sums of the gradients of all weights over the scored positions of windows of ids, as one array; the last is how many positions."""
    out, classes = np.zeros(sum(v.size for v in w.values()) + 1), np.append(classes, CLASSES).astype(np.int64)
    for lo in range(0, len(laid), TRAINED):
        some = classes[laid[lo : lo + TRAINED]]
        y = some[:, 1:]
        on = (y < CLASSES).astype(np.float32)
        on[:, :OVERLAP] = 0
        g, _ = gradients(w, bigram, sets, some[:, :-1], np.where(y < CLASSES, y, 0), on)
        n = on.sum(dtype=np.float64)
        out += n * np.append(np.concatenate([np.ravel(g[k]) for k in w]), 1)
    return out


def trained(bigram: np.ndarray, sets: np.ndarray, sums) -> dict[str, np.ndarray]:
    """The weights after all rounds; ``sums(round, weights)`` are the gradient sums over the windows of a round."""
    w = start_weights()
    opt = Adam(w)
    cuts = np.cumsum([v.size for v in w.values()])
    for k in range(ROUNDS):
        got = sums(k, w)
        if got[-1]:
            opt.step(w, {n: (g / got[-1]).reshape(w[n].shape) for n, g in zip(w, np.split(got[:-1], cuts[:-1]), strict=True)})
    return w


def start(texts: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """What ``learn`` makes on Spark, for ids of texts in one process: classes, their sets, their log bigram and the attention's weights."""
    none = np.zeros(0, np.int64)
    key, n = id_pairs(np.concatenate([none, *[np.append(size, t[:-1]) for t in texts]]), np.concatenate([none, *texts]), None, size)
    frequent = Frequent(np.bincount(key % size, n, size))
    classes = frequent.classed(frequent.neighbours(key, n))
    pairs = class_pairs(classes, key, n)
    bigram, sets = log_bigram(pairs), class_sets(pairs)
    laid = [laid_out(t, size) for t in texts] or [(np.zeros((0, WINDOW + 1), np.uint16), none)]
    x, rounds = np.concatenate([a for a, _ in laid]), np.concatenate([b for _, b in laid])
    return classes, sets, bigram, trained(bigram, sets, lambda k, w: gradient_sums(w, bigram, sets, classes, x[rounds == k]))


# -- on Spark

#: Kinds of counts: words, pairs of ids (k: the key), chunk pairs (a: the chunk before, k: the pair); windows of a round k are of kind LAID_OUT + k.
WORDS, PAIRS, PASSAGES, LAID_OUT = range(4)
_STATS = "kind int, word binary, a long, k long, n long"


def _stats_batch(kind: int | np.ndarray, n: np.ndarray, word: list | None = None, a: np.ndarray | None = None, k: np.ndarray | None = None) -> pa.RecordBatch:
    none = np.zeros(len(n), np.int64)
    columns = [pa.array(np.full(len(n), kind, np.int32)), pa.array(word, pa.binary()) if word is not None else pa.nulls(len(n), pa.binary()), *[pa.array(none if x is None else x) for x in (a, k)], pa.array(n)]
    return pa.RecordBatch.from_arrays(columns, ["kind", "word", "a", "k", "n"])


def _counter(vocabulary, key):
    """Counts of words, id pairs and chunk pairs of a task's texts, and their windows of ids by rounds."""

    def run(batches):
        memory_kept()
        sub = remembered("plain", key, lambda: Subwords(*vocabulary.value))
        known, counts = Numbered(sub), np.zeros(0, np.int64)
        pairs = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        laid: list[list[np.ndarray]] = [[] for _ in range(ROUNDS)]
        held_bytes = 0

        def paired(before, ids, n):
            nonlocal pairs
            k, c = id_pairs(before, ids, n, sub.size)
            k, at = np.unique(np.concatenate([pairs[0], k]), return_inverse=True)
            pairs = k, np.bincount(at, np.concatenate([pairs[1], c]), len(k)).astype(np.int64)

        def flushed():
            """Word counts and pairs; pairs inside words follow from the counts of words."""
            nonlocal pairs
            some, all_words = np.nonzero(counts)[0], list(known)
            for lo in range(0, len(some), 50_000):
                part = some[lo : lo + 50_000]
                ids, size = known.streams(part)
                word = np.repeat(np.arange(len(part)), size)
                inside = word[1:] == word[:-1]
                paired(ids[:-1][inside], ids[1:][inside], np.repeat(counts[part], size)[1:][inside])
                yield _stats_batch(WORDS, counts[part], [all_words[k] for k in part.tolist()])
            yield _stats_batch(PAIRS, pairs[1], k=pairs[0])
            pairs = (pairs[0][:0], pairs[1][:0])

        def taken(texts):
            """Count a block of texts; their chunk pairs are returned."""
            nonlocal counts, held_bytes
            numbers = [known.numbers(ws) for ws in texts]
            known.arranged()
            flat = np.concatenate(numbers)
            now = np.bincount(flat, minlength=len(known))
            now[: len(counts)] += counts
            counts = now
            # Pairs over the ends of words, and of what stands before a text.
            ends = np.cumsum([len(ws) + 1 for ws in texts])
            first, last = (x[flat] for x in known.ends)
            before = np.concatenate([[sub.size], last[:-1]])
            before[ends[:-1]] = sub.size
            paired(before, first, None)
            both = [laid_out(known.streams(n)[0], sub.size) for n in numbers]
            x, rounds = np.concatenate([a for a, _ in both]), np.concatenate([b for _, b in both])
            order = np.argsort(rounds, kind="stable")
            for k, part in enumerate(np.split(x[order], np.searchsorted(rounds[order], np.arange(1, ROUNDS)))):
                laid[k].append(part)
            held_bytes += x.nbytes
            _, a, k = chunks(known.hash[flat], ends)
            return _stats_batch(PASSAGES, np.ones(len(k), np.int64), None, a.view(np.int64), k.view(np.int64))

        def handed():
            nonlocal held_bytes
            some = [(k, np.concatenate(x)) for k, x in enumerate(laid) if x]
            for x in laid:
                x.clear()
            held_bytes = 0
            return _stats_batch(np.array([LAID_OUT + k for k, _ in some], np.int32), np.array([len(x) for _, x in some], np.int64), [x.tobytes() for _, x in some])

        for b in batches:
            texts, held = [], 0
            for x in b.column(0):
                texts.append(words_of(x.as_py()))
                held += len(texts[-1])
                if held > 200_000:
                    yield taken(texts)
                    texts, held = [], 0
            if texts:
                yield taken(texts)
            if held_bytes > LAID:
                yield handed()
            if len(known) >= PARTIAL or len(pairs[0]) >= PAIRED:
                yield from flushed()
                known, counts = Numbered(sub), np.zeros(0, np.int64)
        yield from flushed()
        yield handed()

    return run


def _summed(keys: DataFrame, cells, size: int) -> np.ndarray:
    """Sums by cell over all rows of ``keys(k, n)``; ``cells(k, n)`` are a batch's, ``size`` of them."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += cells(b.column(0).to_numpy(), b.column(1).to_numpy())
        some = np.nonzero(total)[0]
        for lo in range(0, len(some), 50_000):
            part = some[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["i", "n"])

    found = keys.select("k", "n").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("i").to_numpy()] = found.column("n").to_numpy()
    return out


def _round_sums(laid: DataFrame, w: dict, bigram: np.ndarray, sets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Gradient sums over all windows of ``laid(word)``."""

    def run(batches):
        memory_kept()
        total = np.zeros(sum(v.size for v in w.values()) + 1)
        for b in batches:
            for x in b.column(0):
                total += gradient_sums(w, bigram, sets, classes, np.frombuffer(x.as_buffer(), np.uint16).reshape(-1, WINDOW + 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    found = laid.select("word").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(sum(v.size for v in w.values()) + 1)
    out[found.column("i").to_numpy()] = found.column("v").to_numpy()
    return out


@dataclass
class Model:
    """What scoring needs: network, class bigram, ids within classes, listed words; all of bounded size."""

    classes: np.ndarray
    sets: np.ndarray
    weights: dict[str, np.ndarray]
    bigram: np.ndarray
    id_logs: np.ndarray
    total: int
    top: dict[bytes, int]
    #: Least count of words that have a share, and the sum of the shares.
    least: int = 1
    mass: float = 1.0
    kept: float = 0.5
    discount: float = 0.5

    def __post_init__(self) -> None:
        self.scorer = Scorer(self.weights, self.bigram, self.sets)


@dataclass
class Counts:
    """Tables of word counts (word, c) and chunk pairs (k, c, c_before), and the training tokens and distinct ones."""

    words: DataFrame
    passages: DataFrame
    total: int
    distinct: int


def learn(docs: DataFrame, ranks_file: str) -> tuple[Model, Counts]:
    """The model and its tables from all rows of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(ranks_file))
    sub_size = Subwords(*vocabulary.value).size
    path = scratch_path(spark, "lm-told")
    # A folder for each kind, and so for each round.
    docs.select("text").mapInArrow(_counter(vocabulary, ranks_file), _STATS).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    told = spark.read.schema("word binary, a long, k long, n long, kind int").parquet(path)
    stats = stored(told.where(F.col("kind") < LAID_OUT).groupBy("kind", "word", "a", "k").agg(F.sum("n").alias("n")), "lm-stats")

    # Fixed numbers of rows: ids of the vocabulary, cells of neighbours, class pairs.
    pairs = stats.where(F.col("kind") == PAIRS)
    id_counts = _summed(pairs, lambda k, n: np.bincount(k % sub_size, n, sub_size).astype(np.int64), sub_size)
    frequent = Frequent(id_counts)
    classes = frequent.classed(_summed(pairs, frequent.neighbours, len(frequent.some) * 512))
    by_class = _summed(pairs, lambda k, n: class_pairs(classes, k, n), (CLASSES + 1) * CLASSES)
    bigram, sets = log_bigram(by_class), class_sets(by_class)
    w = trained(bigram, sets, lambda k, now: _round_sums(told.where(F.col("kind") == LAID_OUT + k), now, bigram, sets, classes)) if id_counts.any() else start_weights()
    id_logs = np.log((id_counts + 0.5) / np.bincount(classes, id_counts + 0.5, CLASSES)[classes]).astype(np.float32)
    words = stats.where(F.col("kind") == WORDS).select("word", F.col("n").alias("c"))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least, listing = (max(1, -(-int(total) // 2**bits)) for bits in (SHARE_BITS, min(SHARE_BITS, LISTED_BITS)))
    listed = words.where(F.col("c") >= listing).collect()
    mass = int(total) if least == 1 else words.where(F.col("c") >= least).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    model = Model(classes, sets, w, bigram, id_logs, int(total), {bytes(r["word"]): r["c"] for r in listed}, least, mass / max(1, int(total)))

    passages = stats.where(F.col("kind") == PASSAGES).select("a", "k", F.col("n").alias("c"))
    once, twice, again, whole = passages.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), F.sum(F.when(F.col("c") > 1, F.col("c"))), F.sum("c")).first()
    model.discount = (once + 1) / (once + 2 * twice + 2)
    model.kept = min(0.95, max(1e-6, (again or 0) / max(1, whole or 0)))
    # All texts begin after BEFORE: its count is their number, and no join has to meet them in one place.
    begin = F.col("a") == F.lit(int(BEFORE.view(np.int64)))
    texts = passages.where(begin).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c_before"))
    starts = passages.where(begin).join(F.broadcast(texts), F.lit(True)).select("k", "c", "c_before")
    others = passages.where(~begin)
    others = others.join(others.groupBy("a").agg(F.sum("c").alias("c_before")), "a").select("k", "c", "c_before")
    return model, Counts(words, others.unionByName(starts), int(total), int(distinct))


def word_logs(model: Model, known: Numbered, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts as words: natural log probability of every word and end by the attention model, their listed counts and hashes, and the places after each text."""
    numbers = [known.numbers(ws) for ws in texts]
    known.arranged()
    found = [known.streams(n) for n in numbers]
    both = [windows(model.classes[ids]) for ids, _ in found]
    x, y = np.concatenate([a for a, _ in both]), np.concatenate([b for _, b in both])
    logs = np.empty((len(x), WINDOW - OVERLAP), np.float32)
    for lo in range(0, len(x), CHUNK):
        got = model.scorer.log_probabilities(x[lo : lo + CHUNK], np.maximum(y[lo : lo + CHUNK], 0))
        logs[lo : lo + CHUNK] = got.reshape(-1, WINDOW - OVERLAP)
    out, at = [], 0
    for n, (ids, size), (a, _) in zip(numbers, found, both, strict=True):
        token = logs[at : at + len(a)].ravel()[: len(ids)].astype(np.float64) + model.id_logs[ids]
        at += len(a)
        out.append(np.add.reduceat(token, np.cumsum(size) - size))
    flat = np.concatenate(numbers)
    return np.concatenate(out), known.count[flat], known.hash[flat], np.cumsum([len(n) for n in numbers])


def mixed(model: Model, logs: np.ndarray, count: np.ndarray, own: np.ndarray | int) -> list[np.ndarray]:
    """For each of MIXES, log probabilities of words: shares of listed ones, ``own`` occurrences left out, mixed with the attention model's; ``scored`` adds those of the others."""
    share = np.maximum(count - own, 0) / np.maximum(1, model.total - own)
    p = np.exp(logs)
    deep = np.nonzero((logs < -600) & (share == 0))[0]
    out = []
    for mix in MIXES:
        now = p * (1 - mix * model.mass)
        now += mix * share
        now[deep] = 1
        np.log(now, out=now)
        now[deep] = logs[deep] + math.log(1 - mix * model.mass)
        out.append(now)
    return out


def text_scores(model: Model, known: Numbered, texts: list[list[bytes]], owns: list[int]) -> list[tuple]:
    """For each text, as words: its log probabilities by MIXES without the memory of passages, tokens, listed tokens and their baseline sum, its chunks' pair keys and log probabilities by MIXES, and the
    other words, their chunks and log probabilities by the attention model."""
    logs, count, hashes, ends = word_logs(model, known, texts)
    starts = ends - np.diff(ends, prepend=0)
    first, _, keys = chunks(hashes, ends)
    q = np.stack([np.add.reduceat(x, first) for x in mixed(model, logs, count, np.repeat(np.array(owns, np.int64), ends - starts))])
    cut = np.append(np.searchsorted(first, starts), len(first))
    plain = np.add.reduceat(q, cut[:-1], axis=1) + np.diff(cut) * math.log(1 - model.kept)
    listed = count > 0
    n_listed = np.add.reduceat(listed, starts, dtype=np.int64)
    base = np.add.reduceat(np.where(listed, np.log10(count + 0.5), 0.0), starts)
    rest: list[list[bytes]] = [[] for _ in texts]
    at = np.nonzero(~listed)[0]
    of = np.searchsorted(ends, at, "right")
    for t, k in zip(of.tolist(), (at - starts[of]).tolist(), strict=True):
        ws = texts[t]
        rest[t].append(ws[k] if k < len(ws) else END_WORD)
    place = (np.searchsorted(first, at, "right") - 1 - cut[of]).astype(np.int32)
    logs, parts = logs[at].astype(np.float32), np.searchsorted(of, np.arange(len(texts) + 1))
    signed = keys.view(np.int64)
    return [
        (plain[:, t], len(ws) + 1, int(n_listed[t]), float(base[t]), rest[t], signed[cut[t] : cut[t + 1]], q[:, cut[t] : cut[t + 1]], place[parts[t] : parts[t + 1]], logs[parts[t] : parts[t + 1]])
        for t, ws in enumerate(texts)
    ]


def scored(docs: DataFrame, model: Model, ranks_file: str, counts: Counts) -> DataFrame:
    """(doc_id, own, n_tokens, n_known, train_tokens, base_score, score) for every row of docs(doc_id, text, own); own is 1 for learnt rows, else 0."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((load_vocabulary(ranks_file), model))
    mixes = range(len(MIXES))
    kind, key = docs.schema["doc_id"].dataType.simpleString(), uuid.uuid4().hex

    def run(batches):
        from pyspark import TaskContext

        memory_kept()
        vocabulary, m = shared.value
        sub, row = remembered("scored", key, lambda: Subwords(*vocabulary)), TaskContext.get().partitionId() << 40
        known = Numbered(sub, m.top)
        for b in batches:
            owns = b.column(2).to_pylist()
            found, block, held = [], [], 0
            for k, x in enumerate(b.column(1)):
                block.append(words_of(x.as_py()))
                held += len(block[-1])
                if held > 40_000 or k + 1 == len(owns):
                    if len(known) > REMEMBERED:
                        known = Numbered(sub, m.top)
                    found += text_scores(m, known, block, owns[k + 1 - len(block) : k + 1])
                    block, held = [], 0
            offsets = lambda parts: pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
            listed = lambda parts, t: pa.ListArray.from_arrays(offsets(parts), pa.array(np.concatenate(parts) if parts else [], t))
            cols = [
                pa.array(range(row, row + len(found)), pa.int64()), b.column(0), b.column(2), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()),
                pa.array([f[3] for f in found], pa.float64()), pa.array([f[4] for f in found], pa.list_(pa.binary())), listed([f[7] for f in found], pa.int32()),
                listed([f[8] for f in found], pa.float32()), listed([f[5] for f in found], pa.int64()),
                *[pa.array([float(f[0][m]) for f in found], pa.float64()) for m in mixes], *[listed([f[6][m] for f in found], pa.float64()) for m in mixes],
            ]
            row += len(found)
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "own", "n_tokens", "listed", "listed_sum", "words", "at", "logs", "k", *[f"plain{m}" for m in mixes], *[f"q{m}" for m in mixes]])

    schema = f"row long, doc_id {kind}, own int, n_tokens long, listed long, listed_sum double, words array<binary>, at array<int>, logs array<float>, k array<long>, "
    schema += ", ".join([f"plain{m} double" for m in mixes] + [f"q{m} array<double>" for m in mixes])
    rows = stored(docs.select("doc_id", "text", "own").mapInArrow(run, schema), "lm-rows")
    # Words that are not listed: those with a count are known, and have their share here.
    rest = rows.select("row", "own", F.explode(F.arrays_zip("words", "at", "logs")).alias("x")).select("row", "own", F.col("x.words").alias("word"), "x.at", F.col("x.logs").cast("double").alias("log"))
    rest = stored(rest.join(counts.words, "word").select("row", "own", "at", "log", "c"), "lm-rest")
    share = F.when(F.col("c") >= model.least, F.greatest(F.col("c") - F.col("own"), F.lit(0)) / F.greatest(F.lit(model.total) - F.col("own"), F.lit(1)))
    # What a share adds to log((1 - mix * mass) * p) where it is mixed in: log(1 + the ratio of both parts).
    softly = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    added = lambda m: F.coalesce(softly(F.log(share) + math.log(MIXES[m] / (1 - MIXES[m] * model.mass)) - F.col("log")), F.lit(0.0))
    sums = lambda of, column: of.where("own = 1").agg(*[F.coalesce(F.sum(column(m)), F.lit(0.0)) for m in mixes]).first()
    plain, more = sums(rows, lambda m: f"plain{m}"), sums(rest, added)
    best = max(mixes, key=lambda m: plain[m] + more[m])
    rows = rows.select("row", "doc_id", "own", "n_tokens", "listed", "listed_sum", "k", F.col(f"plain{best}").alias("plain"), F.col(f"q{best}").alias("q"))
    half, no = math.log10(0.5), F.lit(None).cast("double")
    rest = rest.select("row", "at", (F.log10(F.col("c") + 0.5) - half).alias("base"), F.lit(1).alias("known"), added(best).alias("more"), no.alias("over"))
    # Passages that the corpus has elsewhere: what their memory adds to log((1 - kept) * q).
    met = rows.select("row", "own", F.posexplode(F.arrays_zip("k", "q")).alias("at", "x")).select("row", "at", "own", "x.k", "x.q").join(counts.passages, "k").where("c > own")
    again = (F.col("c") - F.col("own") - model.discount) / (F.col("c_before") - F.col("own"))
    over = F.log(again * (model.kept / (1 - model.kept))) - F.col("q")
    gained = met.select("row", "at", F.lit(0.0).alias("base"), F.lit(0).alias("known"), F.lit(0.0).alias("more"), over.alias("over"))
    # A chunk's q has the shares of all its words first: dealt by row once, for both groupings.
    chunk = rest.unionByName(gained).repartition("row").groupBy("row", "at").agg(*[F.sum(c).alias(c) for c in ("base", "known", "more")], F.max("over").alias("over"))
    gain = F.col("more") + F.coalesce(softly(F.col("over") - F.col("more")), F.lit(0.0))
    sums = chunk.groupBy("row").agg(F.sum("base").alias("base"), F.sum("known").alias("known"), F.sum(gain).alias("gain"))
    whole = math.log10(counts.total + 0.5 * (counts.distinct + 1))
    return rows.drop("k", "q").join(sums, "row", "left").select(
        "doc_id",
        "own",
        "n_tokens",
        (F.col("listed") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("listed_sum") + F.coalesce("base", F.lit(0.0)) + (F.col("n_tokens") - F.col("listed")) * half - F.col("n_tokens") * whole).alias("base_score"),
        ((F.col("plain") + F.coalesce("gain", F.lit(0.0))) / math.log(10)).alias("score"),
    )


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def language_model_scores(docs: DataFrame, folds: int = 5, held: int = 1, ranks_file: str | None = None) -> DataFrame:
    """(doc_id, held_out, ...) for every row; rows with crc32(doc_id) mod ``folds`` = ``held`` aren't learnt."""
    ranks_file = ranks_file or ranks_path()
    rows = docs.select("doc_id", "text", (crc_mod("doc_id", folds) != held).cast("int").alias("own"))
    model, counts = learn(rows.where("own = 1"), ranks_file)
    out = scored(rows, model, ranks_file, counts)
    return out.select("doc_id", (F.col("own") == 0).alias("held_out"), *out.columns[2:])
