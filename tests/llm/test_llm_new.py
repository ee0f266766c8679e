"""Alignment, personal data and periodic runs against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablewise.llm import align, periods, personal
from tablewise.llm.queries import planted_periods, tokenizer_file


# Periodic runs


def slow_runs(words: list, least: int, copies: int) -> list[tuple[int, int, int]]:
    found = []
    for q in range(1, len(words) // copies + 1):
        start = 0
        while start + q < len(words):
            if words[start] != words[start + q]:
                start += 1
                continue
            end = start
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            run = words[start : end + q]
            smallest = all(run[p:] != run[:-p] for p in range(1, q))
            if len(run) >= max(least, copies * q) and smallest:
                found.append((start, len(run), q))
            start = end
    return sorted(found)


def periodic_text(rng: random.Random) -> list[int]:
    words: list[int] = []
    for _ in range(rng.randint(0, 5)):
        period = [rng.randint(0, rng.choice([1, 2, 50])) for _ in range(rng.randint(1, 14))]
        words += (period * rng.randint(1, 7))[: rng.randint(1, 80)]
    return words


@pytest.mark.parametrize("least,copies", [(24, 3), (6, 2), (1, 2), (10, 4), (2, 3)])
def test_runs_equal_brute_force(least, copies):
    rng = random.Random(least * 10 + copies)
    for _ in range(150):
        texts = [periodic_text(rng) for _ in range(rng.randint(1, 4))]
        ends = np.cumsum([len(t) for t in texts])
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        got = periods.runs_of(np.array(sum(texts, []), np.int64), owner, ends, least, copies)
        want = [(s + int(e) - len(t), n, q) for t, e in zip(texts, ends) for s, n, q in slow_runs(t, least, copies)]
        assert got == sorted(want)


def test_periodic_rows(spark):
    rows = [
        (1, None, "x"),
        (2, "", "x"),
        (3, " \t\n", "x"),
        (4, "a b " * 20 + "end", "x"),
        (4, "a b " * 20 + "end", "x"),
        (None, "a " * 24, "x"),
        (5, "word " * 60_000, "x"),
        (6, "a b " * 24, "x"),
        (7, "plain words only", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(docs).collect()), key=str)
    want = [
        (1, 0, [], ""),
        (2, 0, [], ""),
        (3, 0, [], ""),
        (4, 41, [(0, 40, 2)], "a b end"),
        (4, 41, [(0, 40, 2)], "a b end"),
        (None, 24, [(0, 24, 1)], "a"),
        (5, 60_000, [(0, 60_000, 1)], "word"),
        (6, 24, [(0, 24, 1)], "a b"),
        (7, 3, [], "plain words only"),
    ]
    assert got == sorted(want, key=str)
    assert periods.periodic_runs(docs.limit(0)).count() == 0


def test_runs_query(spark, sf_dir):
    import zlib

    from tablewise.llm.queries import op13_periodic_runs

    got = {r.doc_id: r for r in op13_periodic_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        if len(words) > 800:
            continue
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = slow_runs(words, 24, 3)
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = None
        for run in runs:
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (best and best[1] * 1000 // best[2])
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_planted_periods_of_empty_rows(spark):
    docs = spark.createDataFrame([(n, t) for n in range(40) for t in (None, "", " ", "a b c")], "doc_id long, text string")
    assert planted_periods(docs).count() == 160


# Alignment


@pytest.fixture(scope="module")
def files() -> tuple[str, str]:
    return tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def slow_alignment(pair: align.TokenizerPair, texts: list) -> list[tuple]:
    """What ``align_tokens`` returns, from sets of byte offsets and all links one by one."""
    facts, seen = [], Counter()
    for text in texts:
        a, b = pair.encode(text)
        offsets = []
        for ids, names in ((a, pair.a_bytes), (b, pair.b_bytes)):
            at, ends = 0, []
            for i in ids:
                at += len(names[i])
                ends.append(at)
            offsets.append(ends)
        groups, low = [], 0
        for end in sorted(set(offsets[0]) & set(offsets[1])):
            groups.append([[i for i, e in zip(ids, ends) if low < e <= end] for ids, ends in zip((a, b), offsets)])
            low = end
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        seen.update(links.keys())
        facts.append((a, b, groups, links))
    best: dict[int, int] = defaultdict(int)
    for (x, _), n in seen.items():
        best[x] = max(best[x], n)
    out = []
    for a, b, groups, links in facts:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        top = sum(n for p, n in links.items() if seen[p] == best[p[0]])
        digest = hashlib.sha256(written.encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), sum(links.values()), top, sum(n * seen[p] for p, n in links.items()), digest, written))
    return out


TEXTS = [
    None,
    "",
    " ",
    "The quick brown fox, the lazy dog.",
    "The quick brown fox, the lazy dog.",
    "naïve café — 東京都 🙂 ﬁ\r\n\ttabs",
    "holds ▁ itself",
    "<|endoftext|> <s> </s> <0x41>",
    "a" * 3000 + "b" * 777,
    "0123456789" * 300,
    "word, " * 2000,
    "zero\x00width​join\u0085",
]


@pytest.mark.parametrize("frequent", [0, 40, 1 << 17])
def test_alignment_equals_brute_force(spark, files, frequent):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, pairs string")
    got = [tuple(r)[1:] for r in sorted(align.align_tokens(docs, *files, frequent=frequent).collect())]
    assert got == slow_alignment(align.TokenizerPair(*files), TEXTS)
    assert align.align_tokens(docs.limit(0), *files).count() == 0


def test_plain_texts_are_split_as_the_library_does(files):
    pair = align.TokenizerPair(*files)
    rng = random.Random(5)
    signs = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250)] if align.PLAIN.fullmatch(chr(c))]
    for _ in range(400):
        text = " " + "".join(rng.choice(signs) for _ in range(rng.randint(1, 60)))
        assert pair.fast.encode_ordinary(text) == pair.a.encode(text, add_special_tokens=False).ids
    for s in signs:
        text = f" {s}x{s}{s} 1{s}'s {s}"
        assert pair.fast.encode_ordinary(text) == pair.a.encode(text, add_special_tokens=False).ids


def test_pointers_end_at_the_last_token_of_the_group():
    a, b = np.array([1, 4, 6, 9]), np.array([3, 6, 7, 8, 9])
    assert align.terminals(a, b).tolist() == [1, 1, 1, 4, 1, 1, 4, 4, 4]


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_spans(text: str) -> list[tuple[str, int, int]]:
    def fits(kind: str, found: str) -> bool:
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            doubled = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if fits(k, m.group())]


def test_base_spans_equal_brute_force():
    rng = random.Random(11)
    pieces = ["a@b.cc", "@", ".", "-", " ", "é", "x", "1", "22", "255", "256", "1.2.3.4", "0007", "+1", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 30 1234567", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        found = personal.base_spans(text)
        assert [(k, *s) for k in personal.KINDS for s in found[k]] == slow_spans(text)


def test_long_junk_is_read_in_one_pass():
    for sign in ("a", "1", "1.", "+1", "a.", "(at)", "*", "1 "):
        text = sign * (400_000 // len(sign))
        personal.wide_spans(text, personal.base_spans(text))


def test_patterns_discover_identifiers(spark):
    rng = random.Random(3)
    words = ["the", "of", "and", "house", "tree", "blue", "river", "song", "light", "stone"]

    def some(n: int) -> str:
        return " ".join(rng.choice(words) for _ in range(n))

    rows = [(i, f"{some(8)} please write to me at {rng.choice('abcdef')}{i}@mail{i}.example.com {some(5)}") for i in range(30)]
    rows += [(i, f"{some(8)} please write to me at jane{i} (at) host{i} (dot) org {some(5)}") for i in range(30, 36)]
    rows += [(i, f"{some(6)} call me on +1 (20{i % 10}) 555-01{i} {some(5)}") for i in range(40, 60)]
    rows += [(i, f"{some(6)} call me on 020 7946 09{i} {some(5)}") for i in range(60, 64)]
    rows += [(i, f"{some(6)} order 020 7946 08{i} {some(5)}") for i in range(64, 70)]
    rows += [(70, None), (71, ""), (None, "x@y.zz"), (72, "jane30 (at) host30 (dot) org"), (73, "jane30 (at) host30 (dot) org " * 2000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in personal.personal_spans(docs).collect()}
    assert len(got) == len(rows)
    texts = dict(rows)
    for i, r in got.items():
        text = texts[i] or ""
        assert [tuple(s) for s in r.base] == slow_spans(text)
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
        if i is not None and i < 36:
            (span,) = r.spans
            assert text[span.start : span.end] in (re.findall(r"\S+@\S+|jane\d+ \(at\) \S+ \(dot\) org", text))
        elif i is not None and 60 <= i < 64:
            assert [text[s.start : s.end] for s in r.spans] == [f"020 7946 09{i}"]
        elif i is not None and 64 <= i < 72:
            assert r.spans == []
    assert [s.kind for s in got[72].spans] == ["email"]
    assert len(got[73].spans) == 2000
    assert personal.personal_spans(docs.limit(0)).count() == 0


def test_context_hashes_agree(spark):
    text = "Call 12 times: a b, a b"
    hashes = {h for h, _ in personal.contexts(text, len(text))}
    docs = spark.createDataFrame([(text,), (text + " and a b",), (None,)], "text string")
    patterns = spark.createDataFrame([(h,) for h in hashes], "pattern long")
    totals = sorted(r.total for r in personal._context_counts(docs, "text", patterns).collect())
    # ", a b" occurs twice, "a b" and "b" as often as they are written.
    assert totals == [2, 5, 5]
