"""Text operators against brute force, with nulls, empty and long texts, repeats and empty tables."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from tablewise.llm import bpe, decontaminate, lm, quality, simhash, suffix_dedup, token_counts

SCHEMA = "doc_id long, text string, fp int, row string, uid int, spans string, c0 string"


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, "x", 2, "y", "z") for i, t in rows], SCHEMA)


def words(rng, n, letters="abcde"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    passage = words(rng, 90)
    rows = [(i, words(rng, rng.randint(0, 120))) for i in range(40)]
    rows += [(100 + i, words(rng, 30) + " " + passage + " " + words(rng, 20)) for i in range(6)]
    rows += [(200, rows[3][1]), (201, rows[3][1] + " x"), (3, rows[3][1]), (202, None), (203, ""), (204, " \n\t"), (None, words(rng, 70))]
    rows += [(205, "ab" * 3000), (206, "é" * 150 + passage[:230] + "ß"), (207, words(rng, 6000)), (208, "one"), (209, "One two")]
    return rows


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(len(w) - 2, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                root[find(a)] = find(b)
    return [find(i) for i in range(len(prints))]


def test_simhash_groups(spark, texts):
    docs = frame(spark, texts)
    prints = [brute_fingerprint(t) for _, t in texts]
    roots = brute_groups(prints)
    least = {}
    for (key, _), r in zip(texts, roots):
        if key is not None:
            least[r] = min(least.get(r, key), key)
    want = Counter((k, format(p, "016x"), least.get(r)) for (k, _), p, r in zip(texts, prints, roots))
    found = simhash.simhash_groups(docs).select("doc_id", simhash.hex_fingerprint(), "component_id")
    assert Counter(tuple(r) for r in found.collect()) == want


def test_simhash_links_at_two_bits(spark):
    rng = random.Random(1)
    base = rng.getrandbits(63)
    values = [base, base ^ 3, base ^ 3 ^ (1 << 40), base ^ 3 ^ (7 << 50), 0, 1 << 62]
    values += [v - (1 << 64) if v >> 63 else v for v in (rng.getrandbits(64) for _ in range(30))]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long"))
    rooted = {r.node: r.root for r in simhash.components(links).collect()}
    groups = brute_groups([v & (1 << 64) - 1 for v in values])
    for a in range(len(values)):
        for b in range(a):
            same = rooted.get(values[a], values[a]) == rooted.get(values[b], values[b])
            assert same == (groups[a] == groups[b])


def test_keep_one_of_each_group(spark, texts):
    kept = simhash.keep_one(frame(spark, texts))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2]
    roots = brute_groups([brute_fingerprint(t) for _, t in texts])
    want = {}
    for (key, _), r in zip(texts, roots):
        want[r] = min(want.get(r, (True, 0)), (key is None, key or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(want.values())


def brute_repeats(bodies, length):
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = True
        out.append((len(b), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), np.frombuffer(b, np.uint8)[~hit].tobytes()))
    return out


@pytest.mark.parametrize("hot_runs", [5000, 2])
def test_repeated_spans(spark, texts, hot_runs):
    want = brute_repeats([(t or "").encode() for _, t in texts], 200)
    found = suffix_dedup.repeated_spans(frame(spark, texts), hot_runs=hot_runs).collect()
    got = [(r.row.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in found]
    assert Counter(got) == Counter((k, *w) for (k, _), w in zip(texts, want))
    assert any(w[1] for w in want)


def test_without_repeats_keeps_columns_and_whole_characters(spark):
    passage = "é" * 120
    rows = [(1, "aé" + passage), (2, "bé" + passage + "c")]
    kept = {r.doc_id: r for r in suffix_dedup.without_repeats(frame(spark, rows)).collect()}
    assert (kept[1].text, kept[2].text, kept[1].uid) == ("a", "bc", 2)


def test_repeats_of_a_table_with_texts_alone(spark):
    docs = spark.createDataFrame([("x" * 250,), ("y" + "x" * 230,), (None,)], "text string")
    assert sorted((r.text for r in suffix_dedup.without_repeats(docs).collect())) == ["", "", "y"]


@pytest.mark.parametrize("seed", range(40))
def test_collections_against_counting(seed):
    rng = random.Random(seed)
    length = rng.choice([3, 5, 9])
    strings = [bytes(rng.choice(b"ab\x00\xf4") for _ in range(rng.randint(length, 50))) for _ in range(rng.randint(1, 9))]
    seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    marks = suffix_dedup.Collection(strings, length).repeated()
    assert [list(map(bool, m)) for m in marks] == [[seen[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]


def test_collections_hold_groups_of_like_length(monkeypatch):
    """Long strings give a symbol in every round, so short groups must not wait for them."""
    rng = random.Random(5)
    text = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    grams, strings = [], []
    for gram in range(20):
        shared = text(200 if gram % 2 else 340)
        grams += [gram, gram]
        strings += [shared + b"x", shared + b"y"]
    built = []

    class Spy(suffix_dedup.Collection):
        def __init__(self, strings, bound):
            built.append([len(s) for s in strings])
            super().__init__(strings, bound)

    monkeypatch.setattr(suffix_dedup, "Collection", Spy)
    monkeypatch.setattr(suffix_dedup, "COLLECTION", 1000)
    marks = suffix_dedup.mark_groups(grams, strings, [len(s) - 200 for s in strings], 200)
    seen = Counter(s[i : i + 200] for s in strings for i in range(len(s) - 199))
    assert [list(map(bool, m)) for m in marks] == [[seen[s[i : i + 200]] > 1 for i in range(len(s) - 199)] for s in strings]
    assert len(built) > 5 and sum(max(sizes) - min(sizes) > 100 for sizes in built) <= 1


@pytest.mark.parametrize("seed", range(40))
def test_collections_keep_the_order_of_all_suffixes(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab\x00\xf4") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 9))]
    built = suffix_dedup.Collection(strings, 7)
    suffixes = sorted((s[k:], n, s[k - 1] + 1 if k else 0) for n, s in enumerate(strings) for k in range(len(s) + 1))
    # The end of a string stands before all symbols; equal suffixes stand by their strings.
    assert built.bwt.tolist() == [c for _, _, c in suffixes]
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert built.common.tolist() == [0] + [min(7, shared(a[0], b[0])) for a, b in zip(suffixes, suffixes[1:])]


@pytest.mark.parametrize("seed", range(6))
def test_runs_hold_every_window_once(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 700))) for _ in range(20)] + [b"a" * 500, b"abc" * 300]
    got = Counter()
    grams = {}
    for numbers, starts, windows, keys, leads in suffix_dedup.runs(texts, 64):
        for n, s, w, g, lead in zip(numbers, starts, windows, keys, leads):
            for k in range(s, s + w):
                got[n, k] += 1
                body = texts[n][k : k + 64]
                assert grams.setdefault(body, (g, lead - (k - s))) == (g, lead - (k - s))
    assert got == Counter((n, k) for n, t in enumerate(texts) for k in range(len(t) - 63))


def test_runs_of_texts_longer_than_a_chunk():
    rng = random.Random(9)
    text = bytes(rng.choice(b"abcdefgh") for _ in range(suffix_dedup.CHUNK * 2 + 77))
    covered = sorted((s, s + w) for _, starts, windows, _, _ in suffix_dedup.runs([text], 200) for s, w in zip(starts, windows))
    assert covered[0][0] == 0 and covered[-1][1] == len(text) - 199
    assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def brute_scan(bodies, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for body in bodies:
        doc, hit, named = split(body), set(), set()
        for name, text in items:
            item = split(text)
            size = min(window, len(item))
            grams = {tuple(item[a : a + size]) for a in range(len(item) - size + 1)} if size else set()
            for p in range(len(doc) - size + 1 if size else 0):
                if tuple(doc[p : p + size]) in grams:
                    named.add(name)
                    hit |= set(range(p, p + size))
        named = sorted(str(n) for n in named if n is not None)
        out.append((len(doc), len(hit), named, len(hit) > 0 and 20 * len(hit) >= len(doc)))
    return out


@pytest.mark.parametrize("block_words", [1_000_000, 3])
def test_decontamination(spark, block_words):
    rng = random.Random(2)
    items = [(i, words(rng, rng.choice([2, 5, 13, 20]), "ab")) for i in range(8)] + [(7, "x y z"), (None, "q Q 9"), (20, None), (21, ""), (22, "?!")]
    bodies = [words(rng, 60, "ab") for _ in range(30)] + [None, "", "...", "X y-Z", "q q 9", words(rng, 400, "cd") + " " + items[3][1].upper()]
    rows = [(i, b) for i, b in enumerate(bodies)] + [(None, "x y z"), (0, bodies[0])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    found = decontaminate.scan_documents(frame(spark, rows), bench, block_words=block_words).collect()
    want = Counter((k, n, h, tuple(m), c) for (k, _), (n, h, m, c) in zip(rows, brute_scan([b for _, b in rows], items)))
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found) == want
    kept = decontaminate.keep_clean(frame(spark, rows), bench, block_words=block_words)
    assert kept.columns == frame(spark, rows).columns
    assert kept.count() == sum(n for k, n in want.items() if not k[4])


def test_decontaminated_text_loses_its_spans(spark):
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Zz  a, b c d!  y"), (2, None), (3, "a b c")], "doc_id long, text string")
    out = decontaminate.remove_spans(decontaminate.scan_documents(docs, bench, with_text=True))
    assert {r.doc_id: (r.text, r.removed) for r in out.collect()} == {1: ("Zz !  y", 4), 2: (None, 0), 3: ("a b c", 0)}


def brute_removed(body, items, longest, window=13):
    """The text without its runs of over ``longest`` hit words, gaps closed by one space."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    places = [m.span() for m in word.finditer(lower(body))]
    doc, hit = word.findall(lower(body)), set()
    for _, text in items:
        item = word.findall(lower(text))
        size = min(window, len(item))
        grams = {tuple(item[a : a + size]) for a in range(len(item) - size + 1)} if size else set()
        hit |= {q for p in range(len(doc) - size + 1 if size else 0) if tuple(doc[p : p + size]) in grams for q in range(p, p + size)}
    parts, at, going = [], 0, False
    for start in sorted(hit):
        if start - 1 in hit:
            continue
        end = start
        while end in hit:
            end += 1
        if end - start > longest:
            parts.append(body[at : places[start][0]].rstrip())
            at, going = places[end - 1][1], True
    return " ".join(p for p in [*parts, body[at:].lstrip()] if p) if going else body


def test_long_benchmark_runs_leave_kept_documents(spark):
    rng = random.Random(8)
    items = [(1, words(rng, 80, "ab")), (2, words(rng, 20, "ab")), (3, "")]
    filler = words(rng, 2500, "cde")
    bodies = [f"{filler}. {items[0][1].upper()}! {filler}", f"{filler} {items[1][1]}", items[0][1], None, "", f"{items[0][1]} {filler}"]
    rows = list(enumerate(bodies)) + [(0, bodies[0]), (None, bodies[5])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.keep_clean(frame(spark, rows), bench, longest=50)
    assert kept.columns == frame(spark, rows).columns
    want = Counter((k, brute_removed(t, items, 50)) for k, t in rows if not brute_scan([t], items)[0][3])
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want
    assert {t for k, t in want if k == 0} == {f"{filler}. ! {filler}"}
    assert decontaminate.keep_clean(frame(spark, rows).limit(0), bench, longest=50).count() == 0


def test_empty_benchmark(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in decontaminate.scan_documents(docs, bench).collect()] == [(1, 2, 0)]


@pytest.fixture(scope="module")
def word_file():
    return str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))


def test_bpe_matches_the_library(spark, texts, word_file):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(word_file)
    library.no_truncation()
    library.no_padding()
    more = ["It's <|endoftext|>we'LL<|startoftext|> 12½ ΑΣ ﬁ İ", "中文 e\u0301 \x1c\x85 🙂🙂 _-_", "aaaa aaaaaaa abababab", "x" * 5000]
    rows = texts + [(1000 + i, t) for i, t in enumerate(more)]
    encoded = bpe.bpe_encode(frame(spark, rows), word_file)
    found = bpe.bpe_decode(encoded, word_file).collect()
    want = Counter()
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[key, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in found) == want
    at_once = bpe.bpe_encode(frame(spark, rows), word_file, extra=("uid",), decoded=True).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in at_once) == want


def test_gadgets_on_small_vocabularies():
    tokenizers = pytest.importorskip("tokenizers")
    for seed in range(60):
        rng = random.Random(seed)
        vocab = {c: i for i, c in enumerate("abc")}
        merges = []
        while len(merges) < 12:
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
        library = tokenizers.models.BPE(vocab=vocab, merges=merges)
        own = bpe.MergeAutomaton(vocab, merges)
        for _ in range(200):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert own.encode(list(word)) == [t.id for t in library.tokenize(word)], (merges, word)


def test_token_counts_against_splits_word_by_word(spark, texts):
    path = str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken"))
    scores = token_counts.rank_scores(path)

    def pieces(word):
        best = [(0.0, 0)]
        for to in range(1, len(word) + 1):
            best.append(max((best[a][0] + scores[word[a:to]], best[a][1] - 1) for a in range(to) if word[a:to] in scores))
        return -best[-1][1]

    import regex

    some = [r for r in texts if len(r[1] or "") < 2000] + [(999, "Hello,  world's 123 é\n\n"), (998, "ab" * 300)]
    want = Counter()
    for key, text in some:
        split = regex.findall(token_counts.PRE_TOKENS, text or "")
        want[key, len(split), sum(pieces(w.encode()) for w in split)] += 1
    assert Counter(tuple(r) for r in token_counts.count_tokens(frame(spark, some), path).collect()) == want


def test_trie_scores_a_shared_prefix_once():
    trie = token_counts.ForwardTrie({b"a": -1.0, b"b": -1.0, b"ab": -1.5, b"abb": -3.5})
    assert [trie.insert(w) for w in (b"ab", b"abb", b"ab", b"aba", b"")] == [1, 2, 1, 2, 0]
    assert len(trie.best) == 5


def test_lm_base_scores(spark, texts):
    docs = frame(spark, texts)
    model = lm.fit_model(docs)
    found = lm.score_documents(docs, model).collect()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    fold = lambda k: zlib.crc32((str(k) if k is not None else "").encode()) % 7
    counts = Counter(w for k, t in texts if fold(k) != 2 for w in split(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for k, t in texts:
        w = split(t)
        want[k, len(w), sum(counts[x] > 0 for x in w), n, round(sum(log10((counts[x] + 1) / (n + v + 1)) for x in w), 4)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == want
    assert all(r.score < 0 for r in found)


def test_lm_trains_on_every_training_document_once(spark, monkeypatch):
    seen = []

    def average(docs, vocabulary, weights, text, shards):
        seen.extend(r.doc_id for r in docs.select("doc_id").collect())
        return weights

    monkeypatch.setattr(lm, "_average", average)
    lm.fit_model(frame(spark, [(k, "a b %d" % k) for k in range(300)]))
    assert sorted(seen) == [k for k in range(300) if zlib.crc32(str(k).encode()) % 7 != 2]


def test_lm_splits_whole_blocks_as_the_contract_does():
    texts = [b"Ab  aB\x0bC\x1cd", None, b"", b" \t\r\n", b" \xc3\x89 e\x85 \x00 \x0c", bytes(range(256)), b"ab"]
    want = [re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t or b"")) for t in texts]
    for column in (pa.array(texts, pa.binary()), pa.array(texts, pa.binary()).view(pa.string())):
        words, many = lm.split_words(column)
        assert words.to_pylist() == sum(want, []) and many.tolist() == [len(w) for w in want]
    numbers = lm.with_ends(np.arange(len(words)), many, -1)
    assert [x.tolist() for x in np.split(numbers, np.flatnonzero(numbers == -1) + 1)[:-1]] == [
        [*range(a, a + n), -1] for a, n in zip(np.cumsum(many) - many, many.tolist())
    ]
    for end in (-1, 0):
        rare = lm._rare_words(words, np.where(pc.equal(words, b"ab"), 3, -1), many, end).to_pylist()
        expected = [Counter(x for x in w if x != b"ab") + Counter([lm.END] * (end < 0)) for w in want]
        assert [Counter(dict(r)) for r in rare] == expected


def test_lm_exchanges_numbers_and_floats(spark, monkeypatch):
    """Two bytes a word and four a weight, not texts and double sums."""
    docs = frame(spark, [(k, " ".join(f"a word{k} of some length %d" % (i % 70) for i in range(40))) for k in range(60)])
    dealt, plain = [], type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, *a: (dealt.append(self), plain(self, *a))[1])
    words = [b"a", b"of", b"some", b"length", lm.END, *(b"%d" % i for i in range(70)), *(b"x%d" % i for i in range(400))]
    vocabulary = lm.Vocabulary(words, np.arange(len(words), 0, -1), 10**5, 900)
    start = lm.start_weights(vocabulary)
    after = lm._average(docs, vocabulary, start, "text", 3)
    ids, parts = (d.collect() for d in dealt)
    assert sum(len(r.ids) for r in ids) == 2 * 60 * (40 * 6 + 1)
    size = sum(v.size for v in start.values())
    shards = {r.seen for r in parts}
    assert sum(len(r.part) for r in parts) == 4 * size * sum(r.chunk == 0 for r in parts) and sum(r.seen for r in parts if r.chunk == 0) == 60 * 241
    assert shards and all(np.isfinite(v).all() and v.shape == start[k].shape and (v != start[k]).any() for k, v in after.items())


def test_lm_averages_by_words_seen(spark, monkeypatch):
    """One shard a document, each trained alone from the same start."""
    vocabulary = lm.Vocabulary([b"a", b"b", lm.END], np.array([50, 40, 10]), 100, 5)
    start = lm.start_weights(vocabulary)
    texts = ["a b a a", "b " * 700]
    streams = [vocabulary.model[[0, 1, 0, 0, 2]], vocabulary.model[[1] * 700 + [2]]]
    alone = [lm.train(start, vocabulary, s.astype(np.int64)) for s in streams]
    deal = type(spark.range(1)).repartition
    # Dealt by text length, so that no two texts meet in one shard.
    by_length = lambda self, *a: self.repartitionByRange(2, F.length("ids")) if "ids" in self.columns else deal(self, *a)
    monkeypatch.setattr(type(spark.range(1)), "repartition", by_length)
    found = lm._average(frame(spark, list(enumerate(texts))), vocabulary, start, "text", 2)
    for k in start:
        want = sum(w[k].astype(np.float64) * len(s) for w, s in zip(alone, streams)) / sum(map(len, streams))
        assert np.allclose(found[k], want, atol=1e-5), k


def test_lm_models_every_head_word():
    words = [b"w%d" % i for i in range(3000)] + [lm.END]
    vocabulary = lm.Vocabulary(words, np.arange(len(words), 0, -1), 10**7, 4000)
    assert vocabulary.size == len(words) + 1
    assert sorted([*vocabulary.model, vocabulary.other]) == list(range(vocabulary.size))


def test_lm_is_a_distribution_and_keeps_its_state():
    rng = np.random.default_rng(0)
    vocabulary = lm.Vocabulary([b"w%d" % i for i in range(30)] + [lm.END], np.array([*range(60, 30, -1), 5]), 2000, 90)
    weights = lm.start_weights(vocabulary)
    weights["state"] = rng.normal(0, 1, weights["state"].shape).astype(np.float32)
    weights["word_w"] = rng.normal(0, 1, weights["word_w"].shape).astype(np.float32)
    text = rng.integers(0, vocabulary.size, 3 * lm.WINDOW + 5)
    ends = [np.append(text, w) for w in range(vocabulary.size)]
    whole = lm.score_texts(weights, vocabulary, ends)
    assert np.isclose(sum(10 ** (s - lm.score_texts(weights, vocabulary, [text])[0]) for s in whole), 1, atol=1e-3)
    alone = [lm.score_texts(weights, vocabulary, [e])[0] for e in ends[:3]]
    assert np.allclose(alone, whole[:3], atol=1e-3)


def test_lm_gradient_and_training():
    rng = np.random.default_rng(0)
    vocabulary = lm.Vocabulary([b"a", b"b", b"c", lm.END], np.array([50, 40, 30, 10]), 140, 6)
    weights = lm.start_weights(vocabulary)
    stream = np.tile(vocabulary.model[[0, 1, 2, 0, 1, 3]], 20000)
    trained = lm.train(weights, vocabulary, stream)
    before, after = (lm.score_texts(w, vocabulary, [stream[:60]])[0] for w in (weights, trained))
    assert after > 0.5 * before and before < -20


def test_lm_gradients_of_all_weights():
    """Every kind of weight, moved a little up and down over a window of several streams."""
    rng = np.random.default_rng(1)
    vocabulary = lm.Vocabulary([b"w%d" % i for i in range(30)] + [lm.END], np.array([*range(60, 30, -1), 5]), 2000, 90)
    weights = {k: v.astype(np.float64) + rng.normal(0, 0.2, v.shape) for k, v in lm.start_weights(vocabulary).items()}
    x, y = rng.integers(0, vocabulary.size, (2, 4, 7))
    x[1, 3] = vocabulary.end
    state = rng.normal(size=(4, lm.HIDDEN))

    def loss(w):
        inputs, h, total = w["embed"] @ w["input"] + w["bias"], state, 0.0
        for t in range(x.shape[1]):
            h = h * (x[:, t] != vocabulary.end)[:, None]
            h = lm.gates(h, inputs[x[:, t]], w["state"])[0]
            total -= lm.log_chances(w, vocabulary, h, y[:, t]).sum()
        return total / y.size

    g, (words, embed), rows, _ = lm.window_gradients(weights, lm.output_rows(weights), vocabulary, x, y, state)
    g["embed"] = np.zeros_like(weights["embed"])
    g["embed"][words] = embed
    g["word_w"], g["word_b"] = np.zeros_like(weights["word_w"]), np.zeros_like(weights["word_b"])
    for low, high, v in rows:
        g["word_w"][:, low:high], g["word_b"][low:high] = v[:, : lm.HIDDEN].T, v[:, lm.HIDDEN]
    assert g.keys() == weights.keys()
    for name, values in weights.items():
        largest = np.argsort(-np.abs(g[name]).ravel())[:4]
        for flat in [*largest, *rng.integers(0, values.size, 6)]:
            spot = np.unravel_index(flat, values.shape)
            sides = []
            for step in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in weights.items()}
                moved[name][spot] += step
                sides.append(loss(moved))
            assert np.isclose((sides[0] - sides[1]) / 2e-5, g[name][spot], atol=1e-7), (name, spot)


def test_lm_output_layer_in_small_pieces():
    """No array of all states by all classes, which would leave the cache; neighbouring classes move together."""
    rng = np.random.default_rng(2)
    vocabulary = lm.Vocabulary([b"w%d" % i for i in range(5000)] + [lm.END], np.arange(5001, 0, -1), 10**8, 9000)
    weights = {k: v.astype(np.float32) for k, v in lm.start_weights(vocabulary).items()}
    target = rng.integers(0, vocabulary.size, 1 << 15)
    states = rng.normal(0, 0.3, (len(target), lm.HIDDEN)).astype(np.float32)
    tracemalloc.start()
    found = lm.log_chances(weights, vocabulary, states, target)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(found).all() and peak < len(target) * lm.CLASSES * 4
    x, y = rng.integers(0, vocabulary.size, (2, 64, lm.WINDOW))
    out = lm.output_rows(weights)
    _, _, rows, _ = lm.window_gradients(weights, out, vocabulary, x, y, np.zeros((64, lm.HIDDEN), np.float32))
    met = np.unique(vocabulary.of_class[y])
    covered = sorted(k for low, high, _ in rows for k in set(vocabulary.of_class[low:high]))
    assert covered == met.tolist() and len(rows) < len(met) / 2
    assert all(len(v) == high - low for low, high, v in rows)


@pytest.mark.parametrize("shift", [0.0, 300.0, -300.0])
@pytest.mark.parametrize("spread", [1.0, 80.0])
def test_lm_chances_far_from_one(shift, spread):
    """Logits whose exponentials are no floats."""
    rng = np.random.default_rng(3)
    vocabulary = lm.Vocabulary([b"w%d" % i for i in range(400)] + [lm.END], np.arange(401, 0, -1), 10**6, 900)
    weights = lm.start_weights(vocabulary)
    for name in ("class_w", "word_w"):
        weights[name] = rng.normal(0, spread, weights[name].shape).astype(np.float32)
    for name in ("class_b", "word_b"):
        weights[name] = weights[name] + np.float32(shift)
    target = rng.integers(0, vocabulary.size, 2500)
    h = rng.uniform(-1, 1, (len(target), lm.HIDDEN)).astype(np.float32)
    wide = {k: v.astype(np.float64) for k, v in weights.items()}

    def slow(state, word):
        total = 0.0
        k = vocabulary.of_class[word]
        low, high = vocabulary.bounds[k], vocabulary.bounds[k + 1]
        for logits, at in (
            (state @ wide["class_w"] + wide["class_b"], k),
            (state @ wide["word_w"][:, low:high] + wide["word_b"][low:high], word - low),
        ):
            total += logits[at] - logits.max() - np.log(np.exp(logits - logits.max()).sum())
        return total

    want = [slow(a, b) for a, b in zip(h.astype(np.float64), target)]
    assert np.allclose(lm.log_chances(weights, vocabulary, h, target), want, rtol=1e-4, atol=2e-3)
    g, rows, back = lm._output_gradients(weights, lm.output_rows(weights), vocabulary, h, target)
    assert all(np.isfinite(v).all() for v in (*g.values(), back, *(v for _, _, v in rows)))


def test_lm_scores_equal_one_step_after_the_other():
    rng = np.random.default_rng(4)
    vocabulary = lm.Vocabulary([b"w%d" % i for i in range(400)] + [lm.END], np.arange(401, 0, -1), 10**6, 900)
    weights = {k: v + rng.normal(0, 0.1, v.shape).astype(np.float32) for k, v in lm.start_weights(vocabulary).items()}
    texts = [rng.integers(0, vocabulary.size, n) for n in (0, 1, 31, 32, 33, 100, 5)]

    def slow(text):
        h, last, total = np.zeros(lm.HIDDEN), vocabulary.end, 0.0
        sigmoid = lambda v: 1 / (1 + np.exp(-v))
        for word in text:
            a = weights["embed"][last] @ weights["input"] + weights["bias"]
            s = h @ weights["state"]
            z, r = sigmoid(a[: lm.HIDDEN] + s[: lm.HIDDEN]), sigmoid(a[lm.HIDDEN : 2 * lm.HIDDEN] + s[lm.HIDDEN : 2 * lm.HIDDEN])
            n = np.tanh(a[2 * lm.HIDDEN :] + r * s[2 * lm.HIDDEN :])
            h = (1 - z) * n + z * h
            k = vocabulary.of_class[word]
            low, high = vocabulary.bounds[k], vocabulary.bounds[k + 1]
            by_class = h @ weights["class_w"] + weights["class_b"]
            by_word = h @ weights["word_w"][:, low:high] + weights["word_b"][low:high]
            total += by_class[k] - np.log(np.exp(by_class).sum()) + by_word[word - low] - np.log(np.exp(by_word).sum())
            last = word
        return total / np.log(10)

    assert np.allclose(lm.score_texts(weights, vocabulary, texts), [slow(t) for t in texts], rtol=1e-4, atol=1e-4)


def test_quality_on_separable_texts(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        rows.append((i, words(rng, 40) if good else words(rng, 40).replace(" ", "$$$ ")))
        labels.append((i, int(good)))
    rows += [(900, None), (901, ""), (902, "$$$"), (None, words(rng, 30)), (0, rows[0][1]), (903, words(rng, 40_000))]
    docs = frame(spark, rows)
    marks = spark.createDataFrame(labels + [(5, 1), (None, 0), (7, None), (12345, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs, marks)
    found = quality.score_quality(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    truth = dict(labels)
    held = [(r.score, truth[r.doc_id]) for r in found if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(s >= 0.3) == bool(y) for s, y in held]) > 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score >= 0.3 for r in found)


def test_quality_without_labels_of_both_classes(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    for rows, score in (([], 0.5), ([(1, 1)], 0.99)):
        model = quality.fit_quality(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert [round(r.score, 6) for r in quality.score_quality(docs, model).collect()] == [score, score]


def test_empty_tables(spark, word_file):
    docs = frame(spark, [])
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, quality int")
    outputs = [
        simhash.simhash_groups(docs),
        simhash.keep_one(docs),
        suffix_dedup.repeated_spans(docs),
        suffix_dedup.without_repeats(docs),
        decontaminate.scan_documents(docs, bench),
        bpe.bpe_decode(bpe.bpe_encode(docs, word_file), word_file),
        lm.score_documents(docs, lm.fit_model(docs)),
        quality.score_quality(docs, quality.fit_quality(docs, marks)),
    ]
    assert [o.count() for o in outputs] == [0] * len(outputs)


def test_digests_of_the_query(spark, texts, word_file):
    ids = [r for r in bpe.bpe_encode(frame(spark, [(1, "the the")]), word_file).select(F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256)).collect()]
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(word_file)
    want = " ".join(map(str, library.encode("the the", add_special_tokens=False).ids))
    assert ids[0][0] == hashlib.sha256(want.encode()).hexdigest()
