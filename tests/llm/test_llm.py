"""Operators on documents against brute force, and the defined results of odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from cairn.llm import common, decontamination, fingerprints, jaccard, language, mixing, privacy, quality, secrets, tokens, toxicity
from cairn.llm import components as linked
from cairn.llm.common import cut_lineage
from cairn.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


def frame(spark, texts, schema=SCHEMA):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t) if t else 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


ODD = [None, "", " \n\t", "a", "word " * 30_000, "x" * 50_000, "é ß", "same text", "same text", "12.1.1.1 4111 1111 1111 1111"]


@pytest.fixture(scope="module")
def odd(spark):
    docs = frame(spark, ODD)
    extra = docs.unionByName(docs.where("doc_id = 7")).unionByName(spark.createDataFrame([(None, "no id", None, None, None)], SCHEMA))
    # Names that operators use inside.
    return extra.selectExpr("*", "1 AS size", "2 AS row", "'z' AS digest", "3 AS spans", "4 AS label", "5 AS strip")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# ---- near duplicates ----


def brute_components(texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", "one", "One", "one two three", "one two three four"]
    for n in (6, 9, 14, 40, 130):
        base = words(n, n)
        for edits in (0, 0, 1, 1, 2, 3, 5):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(n)] = f"e{rng.random()}"
            texts.append(" ".join(w))
        texts.append(" ".join(base[: n - n // 6]))
    # A chain whose ends are not similar, and a passage that many documents share.
    chain = words(60, 1)
    for step in range(8):
        texts.append(" ".join(chain[step * 3 : step * 3 + 40]))
    shared = words(30, 2)
    texts += [" ".join(words(20 + k % 7, 100 + k) + shared) for k in range(25)]
    got = jaccard.near_duplicates(frame(spark, texts)).collect()
    assert sorted(tuple(r) for r in got) == brute_components(texts)


def test_a_large_group_around_the_threshold(spark):
    rng, base = random.Random(8), words(70, 9)
    texts = [" ".join(base)]
    for k in range(120):
        w = list(base)
        for at in rng.sample(range(70), k % 8):
            w[at] = f"e{k}-{at}" if k % 3 else f"e{at}"
        texts.append(" ".join(w))
    got = jaccard.near_duplicates(frame(spark, texts)).collect()
    assert sorted(tuple(r) for r in got) == brute_components(texts)


def test_signatures_meet_for_every_similar_pair():
    rng = np.random.default_rng(1)
    level, met = rng.integers(0, 40, jaccard.LEVELS).astype(np.uint8), 0
    for _ in range(4000):
        n = int(rng.integers(1, 150))
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        common = s[: len(s) - int(rng.integers(0, len(s) // 4 + 1))]
        other = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, int(rng.integers(0, len(s) // 3 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(s, other))
        if len(other) and 100 * both >= 75 * (len(s) + len(other) - both) and both < max(len(s), len(other)):
            met += 1
            assert set(jaccard.signatures(s, level).tolist()) & set(jaccard.signatures(other, level).tolist())
    assert met > 500


def test_sets_that_fill_few_partitions_meet_by_their_elements(monkeypatch):
    whole = jaccard._tokens
    monkeypatch.setattr(jaccard, "_tokens", lambda elements, tag: whole(elements, tag)[:1] + elements[:1])
    level, s = np.zeros(jaccard.LEVELS, np.uint8), np.arange(100, 140, dtype=np.uint64)
    other = np.concatenate([np.array([7], np.uint64), s[1:]])
    assert set(jaccard.signatures(s, level).tolist()) & set(jaccard.signatures(other, level).tolist())


def test_pairs_of_cells_across_batches_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 90).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(90) < 0.93], rng.integers(0, 1 << 63, int(rng.integers(0, 25))).astype(np.uint64)])) for _ in range(70)]
    rows = [(k, len(s), jaccard.parity_of(s).tolist()) for k, s in enumerate(sets)]
    classes = spark.createDataFrame(rows, "digest long, n long, parity array<long>")
    found = spark.createDataFrame([(1, k, k % 23, 70) for k in range(70)] + [(2, k, k % 23, 5) for k in range(5)], "bucket long, digest long, label long, size long")
    similar = set()
    for i in range(70):
        for j in range(i + 1, 70):
            both = len(np.intersect1d(sets[i], sets[j]))
            if i % 23 != j % 23 and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                similar.add((i, j))
    for cell in (jaccard.CELL, 20):
        jaccard.CELL, before = cell, jaccard.CELL
        try:
            got = {tuple(r) for r in jaccard.across(found, classes, False).collect()}
            best = {tuple(r) for r in jaccard.across(found, classes, True).collect()}
        finally:
            jaccard.CELL = before
        assert len(similar) > 50 and similar <= got
        assert best <= got and {x % 23 for pair in best for x in pair} == {x % 23 for pair in got for x in pair}


def test_many_short_texts_and_frequent_lines(spark):
    rng = random.Random(4)
    lines = [" ".join(words(8, 500 + k)) for k in range(30)]
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    texts += [" ".join(rng.choice(lines) for _ in range(rng.randrange(1, 6))) for _ in range(500)]
    got = jaccard.near_duplicates(frame(spark, texts)).collect()
    assert sorted(tuple(r) for r in got) == brute_components(texts)


def test_components_of_a_chain(spark):
    got = components(spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(31)} | {(50, 50), (51, 50)}


def test_components_join_links_in_shares_first(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(linked, "cut_lineage", lambda df: cuts.append(cut_lineage(df)) or cuts[-1])
    dense = [(i, j) for i in range(0, 200, 2) for j in range(i + 2, 200, 2)]
    long = [(i, i + 1) for i in range(10_000, 12_000)]
    got = components(spark.createDataFrame(dense + long, "a long, b long").repartition(9))
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(0, 200, 2)} | {(i, 10_000) for i in range(10_000, 12_001)}
    # One link a node is left, and few rounds: each cut is a round of joins and shuffles.
    assert cuts[1].count() == 99 + 2000
    assert len(cuts) <= 6


def test_components_of_many_shares(spark, monkeypatch):
    monkeypatch.setattr(linked, "LOCAL", 7)
    rng = random.Random(5)
    links = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(i, i + 1) for i in range(2000, 2100)] + [(4000, 4000), (None, 1), (2, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert sorted(tuple(r) for r in got) == sorted((x, root(x)) for x in parent)


# ---- decontamination ----


def test_copies_and_paraphrases_are_found_and_clean_documents_stay(spark):
    rng = random.Random(3)
    items = [words(n, 1000 + n, 5000) for n in (15, 22, 30, 41, 55)]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    texts, planted = [], set()
    for k in range(120):
        body = words(150, 5000 + k, 5000)
        if k % 4 == 0:
            item = k // 4 % len(items)
            own = [w if rng.random() > 0.15 or k % 8 else f"p{rng.random()}" for w in items[item]]
            at = rng.randrange(len(body))
            body[at:at] = own
            planted.add((k, item))
        texts.append(" ".join(body))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame(spark, texts), benchmark).collect()}
    assert got <= planted
    assert len(got) >= 0.9 * len(planted)


def test_short_paraphrased_items_are_found(spark):
    rng = random.Random(12)
    sizes = [8, 10, 13, 15, 18, 19, 22, 25, 28, 29]
    items = [words(n, 2000 + k, 4000) for k, n in enumerate(sizes)]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    texts, planted = [], set()
    for k in range(200):
        body, item = words(rng.randrange(150, 300), 3000 + k, 4000), k % len(items)
        own = list(items[item])
        # A quarter of the words replaced, but none of the answer.
        for x in rng.sample(range(len(own) * 2 // 3), len(own) // 4):
            own[x] = f"other{rng.randrange(10**6)}"
        at = rng.randrange(len(body))
        body[at:at] = own
        planted.add((k, item))
        texts.append(" ".join(body))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame(spark, texts), benchmark).collect()}
    assert got <= planted
    for lo, hi in ((8, 16), (16, 20), (20, 30)):
        mine = {p for p in planted if lo <= sizes[p[1]] < hi}
        assert len(got & mine) >= 0.9 * len(mine)


def test_latent_products_go_over_all_passages(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, n)) for n in rng.integers(0, 90, 40)] + [None, ""]
    idf = rng.random(decontamination.FEATURES) + 1
    q = rng.standard_normal((decontamination.FEATURES, 3)).astype(np.float32)
    total, passages = decontamination._product(decontamination.stored_features(frame(spark, texts)), idf, q)
    rows = []
    for text in filter(None, texts):
        data = np.frombuffer(text.encode(), np.uint8)
        own = decontamination.features_of(common.word_hashes(data, np.array([0, len(data)]), common.NOT_ALNUM)[0])
        for at in range(0, max(1, len(own) - decontamination.STEP), decontamination.STEP):
            row = np.bincount(own[at : at + decontamination.WINDOW], minlength=decontamination.FEATURES) * idf
            rows.append(row / np.linalg.norm(row))
    dense = np.array(rows)
    assert passages == len(rows)
    assert np.allclose(total, dense.T @ (dense @ q), atol=1e-4)


def test_last_latent_round_multiplies_projections_with_stored_norms(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9, n)) for n in rng.integers(0, 90, 40)] + [None, ""]
    idf = rng.random(decontamination.FEATURES) + 1
    q = rng.standard_normal((decontamination.FEATURES, 3)).astype(np.float32)
    stored = decontamination.with_norms(decontamination.stored_features(frame(spark, texts)), idf)
    total, passages = decontamination._product(stored, idf, q)
    gram, again = decontamination._product(stored, idf, q, True)
    assert passages == again and gram.shape == (3, 3)
    assert np.allclose(gram, q.T @ total, rtol=1e-3, atol=1e-3)
    # Lengths of passages that repeat words, in the order of the passages of each text.
    weights = idf.astype(np.float32).astype(np.float64)
    for row in stored.collect():
        own = np.frombuffer(row["features"], "<u2").astype(np.int64)
        norms = np.frombuffer(row["norms"], "<f4")
        passage = [own[at : at + decontamination.WINDOW] for at in range(0, max(1, len(own) - decontamination.STEP), decontamination.STEP)] if len(own) else []
        expect = [((np.bincount(p, minlength=decontamination.FEATURES) * weights) ** 2).sum() for p in passage]
        assert len(norms) == -(-len(own) // decontamination.STEP) and np.isinf(norms[len(expect) :]).all()
        assert np.allclose(norms[: len(expect)], expect, rtol=1e-6)


def test_document_frequencies_of_many_short_and_long_texts(spark):
    texts = [" ".join(words(5 + i % 60, i)) for i in range(1500)] + [None, ""]
    got, rows = decontamination.document_frequencies(decontamination.stored_features(frame(spark, texts)))
    expect = np.zeros(decontamination.FEATURES)
    for text in filter(None, texts):
        data = np.frombuffer(text.encode(), np.uint8)
        expect[np.unique(decontamination.features_of(common.word_hashes(data, np.array([0, len(data)]), common.NOT_ALNUM)[0]))] += 1
    assert rows == len(texts) and (got == expect).all()


def test_stretches_given_up_at_once_cannot_cover_an_item(monkeypatch):
    rng = random.Random(8)
    idf, space = np.ones(decontamination.FEATURES), np.ones((decontamination.FEATURES, 4), np.float32)
    own = [rng.randrange(60) for _ in range(30)]
    items = decontamination.Items([1], [np.array(own, np.uint64)], space, idf)
    document = [rng.randrange(60) for _ in range(400)]
    document[200:230] = [w if rng.random() < 0.8 else 99 for w in own]
    begins = list(range(-10, 391, 4))
    calls = []
    plain = decontamination.lcs_length
    monkeypatch.setattr(decontamination, "lcs_length", lambda *a: calls.append(1) or plain(*a))
    given_up = items.hopeless(0, document, begins)
    assert len(calls) < len(begins) / 2 and len(given_up) > len(begins) / 2
    covered = {b for b in begins if items.check(0, document, b, 0)[0] >= decontamination.COVER}
    assert covered and not covered & given_up


def test_latent_rounds_send_sums_of_a_bounded_number_of_tasks(spark, monkeypatch):
    texts = [words(60, i) for i in range(80)]
    plain, widths = decontamination._product, []
    monkeypatch.setattr(decontamination, "_product", lambda stored, *a: widths.append(stored.rdd.getNumPartitions()) or plain(stored, *a))
    stored = decontamination.stored_features(frame(spark, texts).repartition(40))
    space = decontamination.latent_space(stored, np.ones(decontamination.FEATURES), 4)
    assert space.any() and widths == [3 * spark.sparkContext.defaultParallelism] * (decontamination.POWER + 1)


def test_windows_of_a_piece_equal_those_of_each_text():
    bounds = np.append(0, np.cumsum(np.random.default_rng(1).integers(0, 80, 200)))
    for window, step in decontamination.STEPS.items():
        starts, _, rows = decontamination.grid_windows(bounds, window, step)
        expect = [(i, int(s)) for i, n in enumerate(np.diff(bounds)) for s in decontamination.window_starts(int(n), step, window)]
        assert sorted(zip(rows.tolist(), (starts - bounds[rows]).tolist())) == expect


def test_lcs():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        assert decontamination.lcs_length(a, b) == plain(a, b)


# ---- secrets ----


def test_weak_parts_need_complementary_ones(spark):
    blob = "abCD12" * 6
    texts = [
        f"key AKIA{'A' * 16} then {blob} end",
        f"only {blob} end",
        "user=alice password=hunter22 host=db.internal:5432",
        "host=db.internal:5432 alone",
        f"key AKIA{'A' * 16} {'far ' * 200} {blob}",
        "token: short password = 'longenough1'",
    ]
    got = {r["doc_id"]: [s["kind"] for s in r["found"]] for r in secrets.scan(frame(spark, texts)).collect()}
    assert got == {0: ["access", "blob"], 1: [], 2: ["account", "assign", "endpoint"], 3: [], 4: ["access"], 5: ["assign"]}


def test_long_and_url_safe_secrets_and_rests_of_endpoints(spark):
    long, safe, short = "aB3/" * 22 + "==", "aB3_-xY9" * 5, "aB3dE5gH7jK9mN1pQ3"
    url = "https://host.example.com/?token=abcdef123&mode=full"
    texts = [f"account=store1 AccountKey={long}", f"user: ann {safe} end", f"user: ann {short} end", f"user: ann at {url}", f"only {long} and {safe}"]
    got = {r["doc_id"]: {texts[r["doc_id"]][s["start"] : s["end"]] for s in r["found"]} for r in secrets.scan(frame(spark, texts)).collect()}
    assert got == {
        0: {"account=store1", long},
        1: {"user: ann", safe},
        2: {"user: ann", short},
        3: {"user: ann", "https://host.example.com/?", "token=abcdef123", "&mode=full"},
        4: set(),
    }


def test_redaction_changes_only_documents_with_secrets(spark):
    docs = frame(spark, ["password=abcdef123 stays", "clean", None])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact(docs).collect()}
    assert got == {0: ("<secret> stays", 14), 1: ("clean", 5), 2: (None, 0)}


# ---- privacy ----


def test_terms_beside_one_entity_only_are_added(spark):
    texts = [f"{' '.join(words(40, k))} Quintessa wrote from quin@mail.example.com today number {k}" for k in range(4)]
    texts += [f"{' '.join(words(40, 50 + k))} wrote today" for k in range(40)]
    # Few bits: in so small a corpus an entity is never rare.
    rows = privacy.report(frame(spark, texts), bits=2.0).collect()
    for r in rows:
        text = texts[r["doc_id"]]
        got = {(s["kind"], text[s["start"] : s["end"]]) for s in r["spans"]}
        if r["doc_id"] < 4:
            assert ("email", "quin@mail.example.com") in got and ("reveal", "Quintessa") in got
        else:
            assert not got


def test_contexts_reach_over_other_numbers(spark):
    texts = [f"{' '.join(words(40, k))} Quintessa of house {70 + k} paid by 4111-1111 1111-1111 in 2020 to Zebulonia" for k in range(4)]
    texts += [f"{' '.join(words(40, 50 + k))} paid by house" for k in range(40)]
    for r in privacy.report(frame(spark, texts), bits=2.0).where("doc_id < 4").collect():
        shown = {texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] in privacy.ADDED}
        assert {"Quintessa", "Zebulonia"} <= shown


def test_terms_of_the_whole_text_are_added_at_all_their_places(spark):
    """Far from the entity, short or a number, and every time they stand in its text."""
    texts = [f"Lee 7741 {' '.join(words(60, k))} quin@mail.example.com {' '.join(words(60, 20 + k))} LEE and É 7741" for k in range(4)]
    texts += [f"{' '.join(words(120, 50 + k))} and" for k in range(40)]
    for r in privacy.report(frame(spark, texts), bits=2.0).where("doc_id < 4").collect():
        text = texts[r["doc_id"]]
        shown = [(text[s["start"] : s["end"]], s["start"]) for s in r["spans"] if s["kind"] == "reveal"]
        for term in ("Lee", "7741", "LEE", "É"):
            assert [at for got, at in shown if got == term] == [m.start() for m in re.finditer(rf"\b{term}\b", text)]
        assert "and" not in {got for got, _ in shown}


def test_context_terms_are_counted_once(spark):
    docs = frame(spark, ["Quintessa a.b@c.de and a.b@c.de"])
    found = privacy.matches(docs)
    got = [(r["term"], r["start"]) for r in privacy.context_terms(privacy.base_spans(found), found).collect()]
    assert got.count(("quintessa", 0)) == 1


def test_sanitised_text(spark):
    got = {r["doc_id"]: r["text"] for r in privacy.sanitise(frame(spark, ["mail a.b@c.de or +1 (555) 123-4567", "fine", None])).collect()}
    assert got == {0: "mail <email> or <phone>", 1: "fine", 2: None}


def test_invalid_numbers_are_dropped(spark):
    texts = ["256.1.1.1", "1.2.3.4.5", "4111111111111112", "4111-1111 1111-1111", "+12", "0001.02.003.255"]
    got = [[(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in privacy.report(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [[], [("ip", 0, 7)], [], [("card", 0, 19)], [], [("ip", 0, 15)]]


# ---- fingerprints ----


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 60, 900):
        a = rng.integers(0, 1 << 63, 200 + n).astype(np.uint64)
        b = np.concatenate([a[: 200 - n // 10], rng.integers(0, 1 << 63, n).astype(np.uint64)])
        keys, sign = np.concatenate([a, b]), np.repeat([1, -1], [len(a), len(b)])
        got, _, signs = fingerprints.differences(keys, np.zeros(len(keys), np.int64), sign, 1, np.array([18]))
        assert set(got[signs > 0].tolist()) == set(a.tolist()) - set(b.tolist())
        assert set(got[signs < 0].tolist()) == set(b.tolist()) - set(a.tolist())


def test_edited_texts_and_order(spark):
    texts = [f"Text {k}. {' '.join(words(30 + k, k))}.\nEnd {k}." for k in range(40)] + [None, ""]
    rows = fingerprints.fingerprints(frame(spark, texts).repartition(5)).orderBy("doc_id").collect()
    plain = [t or "" for t in texts]
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    for r, own, following in zip(rows, plain, plain[1:] + plain[:1]):
        half = len(own) // 2
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256((own[: len(own) - half] + following[:half]).encode()).hexdigest()
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert rows[-1]["fingerprint"] == rows[-2]["fingerprint"]


# ---- mixing ----


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = frame(spark, [" ".join(words(random.Random(k).randrange(0, 300), k)) for k in range(400)] + [None])
    first, second = (sorted(map(tuple, mixing.mix_sources(docs.repartition(n)).collect()), key=repr) for n in (2, 7))
    assert first == second and len(first) == 401
    per = {}
    for _, source, size, source_size, target, taken in first:
        assert taken <= 2 * size
        t = per.setdefault(source, [target, 0, source_size])
        t[1] += taken
    assert set(per) == {"s0", "s1", "s2", None}
    for target, taken, size in per.values():
        assert target <= 2 * size and abs(taken - target) <= 4 * mixing.BLOCK_WORDS


# ---- models ----


def test_network_gradients():
    rng = np.random.default_rng(0)
    m = {k: v.astype(np.float64) for k, v in quality.start_model().items()}
    x = rng.integers(97, 123, (3, 2, quality.CHUNK_BYTES)).astype(np.uint8)
    n, y = np.array([256, 256, 100]), np.array([0.0, 1.0, 1.0])
    _, g = quality.gradients(m, x, n, y)
    for name, at in (("filters", (3, 4)), ("dense", (5, 6)), ("out", (2,)), ("combine", (1,)), ("bias", (7,)), ("embed", (100, 2))):
        up, down = ({**m, name: m[name].copy()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        slope = (quality.gradients(up, x, n, y)[0] - quality.gradients(down, x, n, y)[0]) / 2e-5
        assert g[name][at] == pytest.approx(slope, rel=2e-2, abs=1e-6)


def test_grammar_scores_clauses():
    g = toxicity.Grammar({"idiot": 4.0}, {"mor": 1.0, "moro": 3.0})
    assert g.clause("you are an idiot".split()) > g.clause("an idiot".split()) > g.clause("not an idiot".split()) > 0
    assert g.clause("he said idiot".split()) < g.clause("an idiot".split()) * toxicity.AIMED
    assert g.clause("i will kill you".split()) == toxicity.THREAT_WEIGHT
    assert g.clause("kill the light".split()) == 0
    assert g.features("the moronic plan")[0] == 3.0


def test_held_out_accuracy(spark):
    good, bad = (lambda k: " ".join(words(60, k)), lambda k: "!!! ".join(["ZZ", "QQ"] * 40))
    texts = [bad(k) if k % 3 == 0 else good(k) + (" you idiot" if k % 2 else "") for k in range(240)]
    docs = frame(spark, texts)
    labels = docs.selectExpr("doc_id", "IF(doc_id % 3 = 0, 0, 1) AS quality", "IF(doc_id % 3 <> 0 AND doc_id % 2 = 1, 1, 0) AS toxic")
    q = quality.score(docs, quality.fit(docs, quality.learnable(labels))).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 != 0) for r in q]) > 0.95
    t = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 != 0 and r["doc_id"] % 2 == 1) for r in t]) > 0.95


def test_language_and_rejection(spark):
    text = {"aa": "tha ond the wher ", "bb": "zuk vol drim kash "}
    docs = spark.createDataFrame([(k, text["ab"[k % 2] * 2] * (1 + k % 9), "ab"[k % 2] * 2, None, 0) for k in range(120)], SCHEMA)
    asked = docs.unionByName(spark.createDataFrame([(1000, None, None, None, 0), (1001, "123 45", None, None, 0)], SCHEMA))
    got = {r["doc_id"]: r for r in language.predict(asked, language.fit(docs)).collect()}
    assert all(got[k]["lang_pred"] == "ab"[k % 2] * 2 for k in range(120))
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1000]["rejected"]


def test_token_counts_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    pytest.importorskip("public_tokenizers")
    texts = [None, "", " ", "  a  b ", "a\nb\tc", "▁x a▁b", "<s>hi</s>", "é ß 漢字　x", "word " * 50, " lead"]
    model = sentencepiece.SentencePieceProcessor(model_file=tokens.tokenizer_path())
    got = tokens.token_counts(frame(spark, texts), tokens.tokenizer_path(), 20).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        n = len(model.encode(t or ""))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), n, n > 20), t


# ---- odd rows, empty tables, clashing columns ----

OPERATORS = {
    "jaccard": jaccard.near_duplicates,
    "secrets": secrets.scan,
    "redact": secrets.redact,
    "privacy": privacy.report,
    "fingerprints": fingerprints.fingerprints,
    "mixing": mixing.mix_sources,
    "tokens": lambda d: tokens.token_counts(d, tokens.tokenizer_path()),
    "quality": lambda d: quality.score(d, quality.fit(d, d.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality"))),
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, d.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic"))),
    "language": lambda d: language.predict(d, language.fit(d)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, odd, none, name):
    if name == "tokens":
        pytest.importorskip("public_tokenizers")
    assert OPERATORS[name](odd).count() == odd.count()
    assert OPERATORS[name](none).count() == 0


def test_decontamination_of_odd_rows(spark, odd, none):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (None, " ".join(words(20, 1))), (3, "few words")], "item_id long, text string")
    assert decontamination.contaminated(odd, benchmark).count() == 0
    assert decontamination.contaminated(none, benchmark).count() == 0
    assert decontamination.contaminated(odd, benchmark.limit(0)).count() == 0
