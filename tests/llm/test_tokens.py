"""Tokenizer alignment against whole encodings and loops over all pairs of tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from textloom.llm import queries, tokens


def plain_components(ends_a, ends_b):
    """Groups by the offsets where tokens of both end."""
    out, a0, b0 = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        a1, b1 = ends_a.index(end) + 1, ends_b.index(end) + 1
        out.append((a0, a1, b0, b1))
        a0, b0 = a1, b1
    return out


def plain(rows):
    """The contract's rows of (doc_id, text), from whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    file_a, file_b = tokens.model_files()
    ta, tb = Tokenizer.from_file(file_a), sentencepiece.SentencePieceProcessor(model_file=file_b)
    ta.encode_special_tokens = True
    alphabet = tokens.byte_alphabet()
    own = []
    for _, text in rows:
        got = None
        if text:
            a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
            bytes_a = [bytes(alphabet[c] for c in ta.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends = lambda xs: [sum(map(len, xs[: k + 1])) for k in range(len(xs))] if len(xs) < 3000 else _running(xs)
                ea, eb = ends(bytes_a), ends(bytes_b)
                links, j0 = [], 0
                for i, e in enumerate(ea):
                    start = e - len(bytes_a[i])
                    while eb[j0] <= start:
                        j0 += 1
                    j = j0
                    while j < len(b) and eb[j] - len(bytes_b[j]) < e:
                        links.append((a[i], b[j]))
                        j += 1
                groups, a0, b0 = [], 0, 0
                at_b = {e: k + 1 for k, e in enumerate(eb)}
                for i, e in enumerate(ea):
                    if e in at_b:
                        groups.append(",".join(map(str, a[a0 : i + 1])) + "|" + ",".join(map(str, b[b0 : at_b[e]])))
                        a0, b0 = i + 1, at_b[e]
                got = (len(a), len(b), groups, links)
        own.append(got)
    counts = Counter(p for x in own if x for p in set(x[3]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (i, _), x in zip(rows, own, strict=True):
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((i, x[0], x[1], len(x[2]), len(x[3]), sum(counts[p] == best[p[0]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()))
    return sorted(out, key=repr)


def _running(xs):
    out, n = [], 0
    for x in xs:
        n += len(x)
        out.append(n)
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_loops(spark, data, documents):
    out = queries.op11_tokenizer_alignment(spark, data)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = rows_of(out)
    assert found == plain([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    assert sum(r[4] for r in found) > 10_000


def odd_texts():
    rng = random.Random(11)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\t", " \n", " ", "　", "é", "日本", "😀", "𐍈", "'s", "12", "!!", "<s>", "</s>", "<|endoftext|>", "\x00", "\x1c", " ", "▁", "word", "Word's"]
    out = ["".join(rng.choices(alphabet, k=rng.randrange(1, 30))) for _ in range(1500)]
    weighted = [x for x in alphabet if x != "▁"]
    return out + ["".join(rng.choices(weighted, k=rng.randrange(1, 40))) for _ in range(1500)]


@pytest.mark.parametrize("limit", [tokens.BROADCAST_PAIRS, 300, 0])
def test_odd_texts_and_both_ways_of_counts(spark, limit):
    rows = [(k % 700, t) for k, t in enumerate(odd_texts())] + [(1, None), (None, None), (2, ""), (None, "same"), (None, "same"), (3, " "), (4, "x" * 20_000), (5, "word " * 50_000)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, pair int, row string").repartition(4)
    assert rows_of(tokens.alignments(df, broadcast_pairs=limit)) == plain(rows)


def test_small_tables_and_groups(monkeypatch):
    """Chunks forgotten between groups change nothing; run in this process, as workers do."""
    x = tokens.Aligner(*tokens.model_files())
    texts = [" ".join(f"w{k % 97} q{k}" for k in range(3000)), None, "one", " ".join(odd_texts()[1500:1900]), "a▁b", "", "z" * 5000]
    plainly = lambda rows: [(*r[:5], r[5].tolist(), r[6].tolist()) for r in rows]
    whole = plainly(x.documents(texts))
    monkeypatch.setattr(tokens, "GROUP", 300)
    monkeypatch.setattr(tokens, "REMEMBERED", 60)
    monkeypatch.setattr(tokens, "JOINED", 40)
    x.forget()
    assert plainly(x.documents(texts)) == whole and len(whole) == 7 and len(x.groups) < 200


def test_components_are_the_minimal_groups():
    rng = random.Random(2)
    for _ in range(500):
        n = rng.randrange(1, 40)
        ends = lambda: np.array(sorted({n, *(rng.randrange(1, n + 1) for _ in range(rng.randrange(0, 20)))}))  # noqa: E731, B023
        a, b = ends(), ends()
        of_a, of_b = tokens.components(a, b)
        groups = [(np.flatnonzero(of_a == g), np.flatnonzero(of_b == g)) for g in range(of_a[-1] + 1)]
        assert [(i[0], i[-1] + 1, j[0], j[-1] + 1) for i, j in groups] == plain_components(a.tolist(), b.tolist())
        i, j, _ = tokens.overlaps(a, b)
        start = lambda e, k: e[k - 1] if k else 0
        assert list(zip(i, j, strict=True)) == [(p, q) for p in range(len(a)) for q in range(len(b)) if start(a, p) < b[q] and start(b, q) < a[p]]


def test_no_rows(spark, empty):
    assert tokens.alignments(empty).count() == 0
