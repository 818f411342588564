"""MinHash near duplicates, ranked search and tokenizer alignment against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cairn.llm import alignment, minhash, ranking, tokens

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n\t", "a", "word " * 3_000, "x" * 20_000, "é ß", "same text", "same text"]


def frame(spark, texts):
    """Texts with their place as id, the last one twice, a row of null id, and clashing names."""
    rows = [*enumerate(texts), (len(texts) - 1, texts[-1]), (None, "no id")]
    extra = "1 AS n, 2 AS row, 3 AS label, 'z' AS digest, 4 AS rank, 5 AS item_id, 6 AS pairs, 7 AS bucket"
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", extra.split(", ")[0], *extra.split(", ")[1:])


# ---- MinHash ----


def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = []
    for members in groups.values():
        known = [rows[i][0] for i in members if rows[i][0] is not None]
        least = min(known) if known else None
        out += [(rows[i][0], len(sets[i]), least, rows[i][0] is None or rows[i][0] == least) for i in members]
    return out


def test_minhash_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    texts = list(ODD) + ["one", "One", "one two three"]
    for n in (5, 9, 14, 40, 130):
        base = [f"w{rng.randrange(400)}" for _ in range(n)]
        for edits in (0, 0, 1, 1, 2, 3, 5):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(n)] = f"e{rng.random()}"
            texts.append(" ".join(w))
        texts.append(" ".join(base[: n - n // 6]))
    chain = [f"c{i}" for i in range(60)]
    for step in range(8):  # neighbours are similar, ends are not
        texts.append(" ".join(chain[step * 3 :] + [f"d{i}" for i in range(step * 3)]))
    passage = " ".join(f"p{i}" for i in range(50))
    texts += [passage + " " + " ".join(f"q{i}x{j}" for j in range(i % 12)) for i in range(60)]
    monkeypatch.setattr(minhash, "CELL", 8)  # buckets of several cells
    docs = frame(spark, texts)
    got = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_groups(rows)
    # A repeated id counts once and both of its rows are told of.
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_bands_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    y = np.append(x[:889], rng.integers(0, 1 << 63, 111).astype(np.uint64))  # 889 / 1111 = 0.80
    flat = np.concatenate([x, y])
    a, b = minhash.band_hashes(flat, np.array([0, 1000]))
    share = (a == b).mean()
    assert 0.25 < share < 0.78  # 0.8 ** 3 = 0.51, 32 bands


# ---- search ----


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_search(rows, items, top):
    tf = [Counter(terms(t)) for _, t in rows]
    n_docs, total = sum(bool(c) for c in tf), sum(sum(c.values()) for c in tf)
    df = Counter(t for c in tf for t in c)
    out = []
    for item_id, query in items.items():
        scores = []
        for (doc, _), c in zip(rows, tf):
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in query if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        scores.sort(key=lambda x: x[:3])
        out += [(item_id, i + 1, x[3], -x[0]) for i, x in enumerate(scores[:top])]
    return out


@pytest.mark.parametrize("block_terms", [200_000, 10])
def test_search_equals_brute_force(spark, monkeypatch, block_terms):
    rng = random.Random(7)
    word = lambda: rng.choice(["The", "of", "naïve", "x1", "Zeta", "日本", "a-b", "don't"]) if rng.random() < 0.5 else f"v{rng.randrange(60)}"
    texts = list(ODD) + [" ".join(word() for _ in range(rng.randrange(1, 80))) for _ in range(120)]
    docs = frame(spark, texts)
    items = [(i, " ".join(word() for _ in range(rng.randrange(0, 25)))) for i in range(30)] + [(3, "zeta of"), (30, None), (31, "unseen"), (None, "zeta")]
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS terms", "2 AS score")
    query = defaultdict(set)
    for item_id, t in items:
        query[item_id] |= set(terms(t))
    monkeypatch.setattr(ranking, "KEPT_ROWS", 50)
    monkeypatch.setattr(ranking, "CELLS", 700)
    got = sorted(map(tuple, ranking.search(docs, table, 7, block_terms).collect()), key=str)
    want = brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], query, 7)
    assert got == sorted(want, key=str)
    assert ranking.search(docs.limit(0), table).count() == 0 and ranking.search(docs, table.limit(0)).count() == 0


def test_query_graph_shares_additions():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 60, 12)
    items = [np.unique(np.concatenate([common[: 6 + i % 6], rng.integers(0, 1 << 60, 5)])) for i in range(40)]
    graph = ranking.mine(items)
    parts = rng.integers(-5, 9, (len(graph.terms), 6))
    want = [parts[np.searchsorted(graph.terms, own)].sum(axis=0) for own in items]
    assert (ranking.accumulate(graph, parts) == np.array(want)).all()
    assert graph.additions() < sum(map(len, items)) * 0.75


# ---- alignment ----


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(tokens.tokenizer_path(alignment.BYTES_MODEL), tokens.tokenizer_path(alignment.PIECES_MODEL))


def brute_groups_of(pair, text):
    if not text:
        return []
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    x, y = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
    whole = (" " + text).encode()
    if b"".join(x) != whole or b"".join(y) != whole:
        return []
    ends = sorted(set(np.cumsum([len(t) for t in x]).tolist()) & set(np.cumsum([len(t) for t in y]).tolist()))
    out, i, j, p, q = [], 0, 0, 0, 0
    for end in ends:
        left, right = [], []
        while p < end:
            left.append(a[i])
            p, i = p + len(x[i]), i + 1
        while q < end:
            right.append(b[j])
            q, j = q + len(y[j]), j + 1
        out.append((left, right))
    return out


def brute_alignment(pair, rows):
    groups = [brute_groups_of(pair, t) for _, t in rows]
    links = [Counter((x, y) for left, right in g for x in left for y in right) for g in groups]
    df = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (x, _), n in df.items():
        best[x] = max(best[x], n)
    out = []
    for (doc, _), g, own in zip(rows, groups, links):
        spelled = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in g)
        out.append((
            doc, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()), sum(n for p, n in own.items() if df[p] == best[p[0]]),
            sum(n * df[p] for p, n in own.items()), hashlib.sha256(spelled.encode()).hexdigest() if g else "",
        ))
    return out


SPARE = [" ", "  ", "\n", "\t", " a", "the", " the", "<s>", "<|endoftext|>", "é", "ß", "日本", "\xa0", "x1", "'s", "!!", "<0x41>", "\x1c", "\x85", "🙂", "    ", "\r\n", "World"]


@pytest.mark.parametrize("settings", [{}, {"chunk": 40, "broadcast_pairs": 0}])
def test_alignment_equals_brute_force(spark, pair, settings):
    rng = random.Random(1)
    texts = [t for t in ODD if t is None or len(t) < 5000] + ["▁ ▁a", "x▁y", " ", "  ", "\n"]
    texts += ["".join(rng.choice(SPARE) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    docs = frame(spark, texts)
    paths = tokens.tokenizer_path(alignment.BYTES_MODEL), tokens.tokenizer_path(alignment.PIECES_MODEL)
    got = sorted(map(tuple, alignment.align(docs, *paths, **settings).collect()), key=str)
    want = brute_alignment(pair, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got == sorted(want, key=str)
    assert alignment.align(docs.limit(0), *paths, **settings).count() == 0


def test_fragments_compose_in_any_order(pair):
    rng = random.Random(2)
    text = " " + "".join(rng.choice(SPARE) for _ in range(400))
    parts, a_byte, b_byte = [], 0, 0
    for a, a2, b, b2 in alignment.chunk_ranges(text, 30):
        parts.append(pair.fragment(text[a:a2], a_byte, text[b:b2], b_byte))
        a_byte, b_byte = a_byte + len(text[a:a2].encode()), b_byte + len(text[b:b2].encode())
    assert len(parts) > 20 and any(len(f.suffix.a) or len(f.suffix.b) for f in parts)
    want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in brute_groups_of(pair, text[1:]))
    for _ in range(20):
        tree = list(parts)
        while len(tree) > 1:
            at = rng.randrange(len(tree) - 1)
            tree[at : at + 2] = [alignment.unpacked(alignment.packed(tree[at] + tree[at + 1]))]
        assert tree[0].whole().text == want


def test_wide_groups_cost_their_distinct_pairs():
    a, b = np.array([1, 1, 2, 3, 3]), np.array([7, 8, 7])
    i, j = np.array([3, 5]), np.array([2, 3])
    plain, wide = (alignment.linked(a, b, i, j, wide=w) for w in (100, 0))
    total = [Counter() for _ in range(2)]
    for counts, (group, pairs, times) in zip(total, (plain, wide)):
        for key, n in zip(zip(group.tolist(), pairs.tolist()), times.tolist()):
            counts[key] += n
    assert total[0] == total[1] and sum(total[0].values()) == 8


def test_token_counts_with_space_marks(spark):
    import sentencepiece

    rng = random.Random(9)
    texts = ["▁ ", "x▁ ▁y"] + ["".join(rng.choice(["▁", " ", "  ", "a", "the", "\t", "\n", "<s>", "é"]) for _ in range(rng.randrange(12))) for _ in range(4000)]
    model = sentencepiece.SentencePieceProcessor(model_file=tokens.tokenizer_path())
    found = tokens.count_texts(texts, tokens.PieceCounts(tokens.tokenizer_path()))
    assert found.tolist() == [len(ids) for ids in model.encode(texts)]


def test_private_patterns_read_long_runs_once_and_match_the_same(spark):
    import time

    from cairn.llm import privacy

    plain = {"email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"}
    rng = random.Random(3)
    texts = ["".join(rng.choice("a1.@-+ 2") for _ in range(rng.randrange(40))) for _ in range(5000)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for kind, pattern in plain.items():
        find = lambda p: f"regexp_extract_all(text, r'{p}', 0)"
        assert docs.where(f"{find(pattern)} <> {find(privacy.PATTERNS[kind])}").count() == 0
        assert docs.where(f"split(text, r'{pattern}', -1) <> split(text, r'{privacy.PATTERNS[kind]}', -1)").count() == 0
    long = spark.createDataFrame([("x" * 300_000 + " a@b.cd " + "1" * 300_000,)], "text string")
    start = time.time()
    counts = long.selectExpr(*[f"size(regexp_extract_all(text, r'{privacy.PATTERNS[k]}', 0)) AS {k}" for k in plain]).first()
    assert tuple(counts) == (1, 0) and time.time() - start < 30
