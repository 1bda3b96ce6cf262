"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

Merging joins, again and again, the adjacent symbols whose concatenation is the best-scored piece (the leftmost of equals). A
sequence of pieces is its result exactly if every two adjacent pieces stay apart when their joint text is
merged alone. So the encoder takes at each place the longest piece that an Aho-Corasick automaton finds there, checks it
against its predecessor by re-merging the pair (remembered by pair), falls back to shorter pieces, and
steps back where none fits; a bitfield marks the places from which nothing fitted.

Texts are cut before such places only where no piece can cross: around characters outside the vocabulary (which
become bytes) and before a space that follows another character, if the vocabulary has no piece with a space in
such a place (else texts stay whole). Encodings of cut-out words are remembered in a bounded table. That changes no result.

Null is the empty text: begin and end ids only. Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import prepare

SPACE = "▁"
REMEMBERED = 400_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def load(model_file: str) -> dict:
    """What the encoder needs of a merge-type model with identity normalisation, as plain values."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kind = lambda i: UNKNOWN if sp.is_unknown(i) else CONTROL if sp.is_control(i) else BYTE if sp.is_byte(i) else UNUSED if sp.is_unused(i) else NORMAL
    n = sp.get_piece_size()
    return {
        "pieces": [sp.id_to_piece(i) for i in range(n)], "scores": [sp.get_score(i) for i in range(n)], "kinds": [kind(i) for i in range(n)],
        "begin": sp.bos_id(), "end": sp.eos_id(),
    }


class Codec:
    def __init__(self, model: dict):
        pieces, kinds = model["pieces"], model["kinds"]
        self.begin, self.end = model["begin"], model["end"]
        self.pieces = pieces
        self.ids = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        self.score = {p: model["scores"][i] for p, i in self.ids.items()}
        self.bytes_ = [0] * 256
        for i, p in enumerate(pieces):
            if kinds[i] == BYTE:
                self.bytes_[int(p[1:-1], 16)] = i
        self.known = set("".join(self.ids))
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.cuts_at_spaces = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.apart: dict[tuple[int, int], bool] = {}
        self.remembered: dict[str, bytes] = {}
        skip, unknown = b"", " ⁇ ".encode()
        self.spoken = [
            skip if k == CONTROL else unknown if k == UNKNOWN else bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(SPACE, " ").encode()
            for p, k in zip(pieces, kinds, strict=True)
        ]

    # -- encoding

    def merged(self, text: str) -> list[str]:
        """The plain merging of a short text, for compatibility checks."""
        symbols, score = list(text), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                s = score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def stay_apart(self, a: int, b: int) -> bool:
        found = self.apart.get((a, b))
        if found is None:
            x, y = self.pieces[a], self.pieces[b]
            found = self.merged(x + y) == [x, y]
            if len(self.apart) >= REMEMBERED:
                self.apart.clear()
            self.apart[a, b] = found
        return found

    def backtracked(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are in the vocabulary."""
        n = len(text)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, match in self.automaton.iter(text):  # by end, so the matches of a start come from short to long
            at[last - match[1] + 1].append(match)
        open_ = bytearray(b"\x01") * (n + 1)
        ids: list[int] = []
        places: list[tuple[int, int]] = []  # of each id: where it starts, its rank among the matches there
        pos, rank = 0, len(at[0]) - 1
        while pos < n:
            here = at[pos]
            while rank >= 0:
                i, length = here[rank]
                if open_[pos + length] and (not ids or self.stay_apart(ids[-1], i)):
                    break
                rank -= 1
            if rank >= 0:
                ids.append(i)
                places.append((pos, rank))
                pos += length
                rank = len(at[pos]) - 1 if pos < n else 0
            else:
                open_[pos] = 0
                ids.pop()
                pos, rank = places.pop()
        return ids

    def run(self, text: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit integers, of a cut-out text."""
        out: list[int] = []
        start = 0
        for k, c in enumerate(text):
            if c not in self.known:
                if k > start:
                    out += self.backtracked(text[start:k])
                out += [self.bytes_[b] for b in c.encode("utf-8", "surrogatepass")]
                start = k + 1
        if start < len(text):
            out += self.backtracked(text[start:])
        return np.array(out, "<u4").tobytes()

    def word(self, text: str) -> bytes:
        got = self.remembered.get(text)
        if got is None:
            got = self.run(text)
            if len(text) <= 64:
                if len(self.remembered) >= REMEMBERED:
                    self.remembered.clear()
                self.remembered[text] = got
        return got

    def encode(self, text: str | None) -> np.ndarray:
        """All ids with begin and end."""
        out = [np.array([self.begin], "<u4").tobytes()]
        if text:
            whole = SPACE + text.replace(" ", SPACE)
            lines = whole.split("\n") if "\n" not in self.known else [whole]
            newline = np.array([self.bytes_[10]], "<u4").tobytes()
            for k, line in enumerate(lines):
                if k:
                    out.append(newline)
                if not self.cuts_at_spaces:
                    out.append(self.run(line))
                    continue
                head, *rest = line.split(SPACE)
                if head:
                    out.append(self.word(head))
                spaces = 1
                for part in rest:
                    if part:
                        out.append(self.word(SPACE * spaces + part))
                        spaces = 1
                    else:
                        spaces += 1
                if spaces > 1:
                    out.append(self.word(SPACE * (spaces - 1)))
        out.append(np.array([self.end], "<u4").tobytes())
        return np.frombuffer(b"".join(out), "<u4")

    # -- decoding

    def decode(self, ids) -> str:
        """The library's decode: control ids are silent, the first space is the dummy prefix, stray bytes become U+FFFD."""
        raw = b"".join(map(self.spoken.__getitem__, np.asarray(ids).tolist()))
        first = next((i for i in map(int, ids) if self.spoken[i]), None)
        if first is not None and self.pieces[first].startswith(SPACE):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self.careful(raw)

    @staticmethod
    def careful(raw: bytes) -> str:
        out, k = [], 0
        while k < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[k : k + n].decode())
                    k += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


_CODECS: dict[str, Codec] = {}


def codec(model: dict, key: str) -> Codec:
    """One codec for each worker process and model."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mapped(docs: DataFrame, model_file: str, schema: str, columns):
    spark = docs.sparkSession
    prepare(spark)
    model = load(model_file)
    key = hashlib.sha256(repr(sorted(model.items())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(model)  # the vocabulary, fixed by the model file

    def run(batches):
        c = codec(shared.value, key)
        for b in batches:
            rows = [columns(c, x.as_py()) for x in b.column(1)]
            names = [x.strip().split(" ")[0] for x in schema.split(",")]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, t) for v, t in zip(cols, columns.types, strict=True)]], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {schema}")


def encoded(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) for every row."""

    def columns(c, text):
        ids = c.encode(text)
        return ids.astype(np.int32), c.decode(ids)

    columns.types = [pa.list_(pa.int32()), pa.string()]
    return _mapped(docs, model_file or model_path(), "ids array<int>, decoded string", columns)


def digests(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row, without moving ids or texts out of the task."""

    def columns(c, text):
        ids = c.encode(text)
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()

    columns.types = [pa.int64(), pa.string(), pa.string()]
    return _mapped(docs, model_file or model_path(), "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)
