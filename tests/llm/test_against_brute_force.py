"""Every query against plain Python over the whole smallest table."""

import hashlib
import math
import random
from collections import Counter, defaultdict

from tests.llm import plain
import pytest
from pyspark.sql import functions as F

from citeflow.llm import jaccard_join, line_dedup, masked_lm, mixing, quality, queries, syncmers
from citeflow.llm.pretokens import default_path


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_mixing(spark, sf, plain_rows):
    got = by_id(mixing.op1(spark, sf))
    assert len(got) == len(plain_rows)
    sizes, taken = Counter(), Counter()
    for i, text, source in plain_rows:
        assert got[i]["size"] == len(plain.words(text))
        assert 0 <= got[i]["taken"] <= 3 * got[i]["size"]
        sizes[source] += got[i]["size"]
        taken[source] += got[i]["taken"]
    targets = plain.mix_targets(sizes)
    for i, _, source in plain_rows:
        assert got[i]["source_size"] == sizes[source]
        assert got[i]["target"] == pytest.approx(targets[source])
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 0.05 * target + 40
    again = by_id(mixing.op1(spark, sf))
    assert all(again[i]["taken"] == r["taken"] for i, r in got.items())


def test_mixing_solves_the_dual(spark):
    """Rates are min(3, exp(tilt * size)) with one tilt a source, and meet the target before rounding."""
    from citeflow.llm.tables import Scratch

    cells = spark.createDataFrame([("sa", 10, 50), ("sa", 100, 20), ("sb", 5, 3), ("sb", 80, 30), ("sc", 7, 9)], "_source string, _size long, n long")
    wanted = spark.createDataFrame([("sa", 2500, 5000.0), ("sb", 2415, 600.0), ("sc", 63, 189.0)], "_source string, source_size long, target double")
    rows = mixing.rates(cells, wanted, Scratch(spark, "test")).collect()
    got = defaultdict(float)
    for r in rows:
        got[r["_source"]] += r["n"] * r["_size"] * r["rate"]
    assert got == pytest.approx({"sa": 5000.0, "sb": 600.0, "sc": 189.0}, rel=1e-6)
    b = {r["_size"]: r["rate"] for r in rows if r["_source"] == "sb"}
    assert math.log(b[80]) / 80 == pytest.approx(math.log(b[5]) / 5, rel=1e-4)


def test_full_and_empty_sources(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a " * 900, "y"), (3, None, "z")], "doc_id long, text string, source string")
    got = {r["row"]["doc_id"]: r for r in mixing.with_copies(docs).collect()}
    assert (got[1]["copies"], got[1]["target"]) == (3, 9.0)
    assert (got[3]["size"], got[3]["target"]) == (0, 0.0)


def test_line_dedup(spark, sf, plain_rows):
    got = by_id(line_dedup.op2(spark, sf))
    want = plain.deduped_lines([(i, t) for i, t, _ in plain_rows])
    same = sum(got[i]["text"] == want[i] for i in want)
    assert len(got) == len(want) and same >= 0.98 * len(want)
    for i, t, _ in plain_rows:
        assert got[i]["n_lines"] == len(t.split("\n"))


def test_near_lines_of_a_large_group(spark):
    """Variants of one line hang together, however many; unlike lines stay."""
    base = "the same long line of text about rivers, bridges and the towns along them, once more for the record"
    rows = [(i, f"{base} {i}\nunlike line {hashlib.md5(str(i).encode()).hexdigest()}") for i in range(400)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = [r for r in got if base in r["text"]]
    assert [r["row"]["doc_id"] for r in kept] == [0]
    assert sum("unlike" in r["text"] for r in got) == 400


def test_small_families_in_a_crowded_bucket(spark):
    """Lines that share a passage meet in crowded buckets; each is still found to be like its one sibling."""
    draw = random.Random(5)
    word = lambda n: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage, n = word(63), 1500
    families = [[(own := word(10)) + word(5), own + word(5)] for _ in range(n)]
    rows = [(side * n + i, passage + family[side]) for i, family in enumerate(families) for side in (0, 1)]
    few = [r for r in rows if r[0] % n < 40]
    for part in (few, rows):
        got = line_dedup.dedup_lines(spark.createDataFrame(part, "doc_id long, text string")).collect()
        kept = {r["row"]["doc_id"] for r in got if not r["n_dropped"]}
        assert kept >= {i for i, _ in part if i < n}
        # Lines that share no band at all are not candidates.
        assert sum(i >= n for i in kept) <= 0.01 * len(part) / 2
    want = plain.deduped_lines(few)
    assert sorted(i for i, t in want.items() if t) == list(range(40))


@pytest.mark.parametrize("union", [10, 20, 40, 60, 100])
def test_recall_of_lines_at_the_limit(spark, union):
    """Pairs of lines at a similarity of 0.8 meet in a band, short ones as well as long ones."""
    draw, n = random.Random(union), 4000
    word = lambda k: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    lines = [common + word(union // 10) for _ in range(n) for common in [word(union * 8 // 10 + 8)] for _ in range(2)]
    signed = line_dedup._signatures(spark.createDataFrame(list(enumerate(lines)), "id long, norm string"))
    bands = range(line_dedup.BANDS)
    rows = {r["id"]: [tuple(r[f"m{b * line_dedup.ROWS + k}"] for k in range(line_dedup.ROWS)) for b in bands] for r in signed.collect()}
    met = sum(any(x == y for x, y in zip(rows[2 * i], rows[2 * i + 1], strict=True)) for i in range(n))
    assert met >= 0.995 * n


def test_prefixes_miss_no_pair(spark):
    """All pairs of a crowd of lines of many lengths that are similar are among the candidates."""
    from citeflow.llm.tables import Scratch

    draw, texts = random.Random(11), []
    for i in range(60):
        base = "".join(draw.choices("abcd ", k=draw.randint(9, 160)))
        for _ in range(6):
            cut = draw.randint(0, len(base) // 4)
            texts.append(base[cut:] + "".join(draw.choices("abcd ", k=draw.randint(0, len(base) // 6))))
    sets = [{t[k : k + 9] for k in range(max(1, len(t) - 8))} for t in texts]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    crowd = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id long, norm string, root long")
    got = {(r["a"], r["b"]) for r in line_dedup._prefix_pairs(crowd, Scratch(spark, "test")).collect()}
    assert len(want) > 200 and want <= got
    assert len(got) < len(sets) * (len(sets) - 1) / 4


def test_secrets(spark, sf, plain_rows):
    got = by_id(queries.QUERIES["op3_secret_scan"](spark, sf))
    kinds = ("assign", "access", "hex")
    for i, text, _ in plain_rows:
        spans = plain.secret_spans(text)
        listed = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(s[1] == n for s in spans) for n in range(3)]
        assert set(filter(None, listed.split(","))) <= set(got[i]["spans"].split(","))


def test_owner_specific_and_copied_values(spark):
    from citeflow.llm.secrets import scan

    one, many = "Zk39fjQ0plMx72Lr8sTv", "aB3dE5gH7jK9mN1pQ4rS"
    rows = [(i, f"value {many} here", f"owner{i}", "en") for i in range(4)] + [(9, f"mine {one} and {many}", "owner9", "en")]
    got = {r["doc_id"]: r["found"] for r in scan(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert [(s["kind"], s["start"], s["verdict"], s["n_owners"]) for s in got[9]] == [(3, 5, "live", 1)]
    assert got[0] == []


def test_masked_lm_beats_word_frequencies_on_held_out_text(spark):
    """Held out, of the thousand documents of sf0.01: the words around tell more than how frequent a word is."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = documents.where("doc_id % 5 <> 0"), documents.where("doc_id % 5 = 0")
    got = masked_lm.token_score(held, masked_lm.fit(train)).collect()
    counts = Counter(w for r in train.collect() for w in (r["text"] or "").lower().split())
    asked = [w for r in held.collect() for w in (r["text"] or "").lower().split()]
    size = sum(counts.values()) + len(counts) + 1
    plain_mean = sum(math.log((counts[w] + 1) / size) for w in asked) / len(asked)
    assert sum(r["n_tokens"] for r in got) == len(asked)
    assert sum(r["log_likelihood"] for r in got) / len(asked) > plain_mean + 0.3


def test_masked_lm_trains_on_every_word():
    """The steps together have every position as a target once, whatever the length of the text."""
    import numpy as np

    texts = [np.arange(n, dtype=np.uint16) % 60 for n in (0, 1, 2, 3, 31, 700, 5000)]
    coded = [masked_lm.padded(x, 64) for x in texts]
    got = [np.column_stack(masked_lm.windows(coded, step)) for step in range(masked_lm.STEPS)]
    want = []
    for i, x in enumerate(texts):
        p = [64] * 2 + x.tolist() + [64] * 2
        want += [(p[t], p[t + 1], p[t + 3], p[t + 4], p[t + 2], i) for t in range(len(x))]
    assert sorted(map(tuple, np.concatenate(got).tolist())) == sorted(want)


def test_masked_lm_learns_order(spark):
    """Real order beats shuffled order clearly where one word follows from the last."""
    draw = random.Random(3)
    follow = {i: draw.sample(range(40), 2) for i in range(40)}
    rows = []
    for i in range(200):
        at, words = draw.randrange(40), []
        for _ in range(300):
            words.append(f"w{at}")
            at = draw.choice(follow[at])
        rows.append((i, " ".join(words)))
    mixed = [(i, " ".join(draw.sample(t.split(), 300))) for i, t in rows[:40]]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    model = masked_lm.fit(frame(rows[40:]))
    mean = lambda r: sum(x["log_likelihood"] for x in masked_lm.token_score(frame(r), model).collect()) / (40 * 300)
    assert mean(rows[:40]) > mean(mixed) + 0.5


def test_masked_lm_does_not_depend_on_the_split(spark, documents):
    scores = []
    for parts in (1, 8, 64):
        split = documents.repartition(parts)
        scores.append(by_id(masked_lm.token_score(split, masked_lm.fit(split))))
    for i, r in scores[0].items():
        for other in scores[1:]:
            assert other[i]["n_tokens"] == r["n_tokens"]
            assert other[i]["per_token"] == pytest.approx(r["per_token"], abs=1e-3)


@pytest.mark.parametrize("listed", [1, 100_000])
def test_lm_scoring_query(spark, sf, plain_rows, monkeypatch, listed):
    """op4 equals a plain version in one process that trains in the same steps and scores word by word, whether
    counts are sent to every task or joined."""
    import zlib

    import numpy as np

    monkeypatch.setattr(masked_lm, "LISTED", listed)
    model, made = None, masked_lm.fit

    def kept(docs):
        nonlocal model
        model = made(docs)
        return model

    monkeypatch.setattr(masked_lm, "fit", kept)
    got = by_id(masked_lm.op4(spark, sf))
    assert len(got) == len(plain_rows)
    texts = [(i, (t or "").lower().split()) for i, t, _ in plain_rows]
    counts = Counter(w for _, t in texts for w in t)
    half = max(16, round(3 * math.log2(len(counts) + 2)))
    own = {w: k for k, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:half])}
    assert [w.decode() for w in model.frequent] == list(own) and model.half == half

    def class_of(w):
        return own[w] if w in own else half + zlib.crc32(w.encode()[-2:]) % half

    sizes = Counter()
    for w, n in counts.items():
        sizes[class_of(w)] += n + 1
    coded = {i: [2 * half] * 2 + [class_of(w) for w in t] + [2 * half] * 2 for i, t in texts}
    met = np.zeros((4, 2 * half + 1, 2 * half))
    for p in coded.values():
        for t in range(2, len(p) - 2):
            for place, off in enumerate((-2, -1, 1, 2)):
                met[place, p[t + off], p[t]] += 1
    net = masked_lm.Network.from_counts(met)
    start = net.flat()
    assert np.abs(model.weights - start).max() > 1e-3
    # The trained weights are better than the start, and both score as written out here.
    means = []
    for weights in (start, model.weights):
        net, total = masked_lm.Network.of(weights, 2 * half), 0.0
        for i, words in texts:
            p, sums = np.array(coded[i]), 0.0
            for t, w in enumerate(words, 2):
                h = np.tanh(net.b + sum(net.e[k][p[t + off]] for k, off in enumerate((-2, -1, 1, 2))))
                s = (h @ net.w + net.c).astype(float)
                sums += s[p[t]] - s.max() - math.log(np.exp(s - s.max()).sum())
                if w not in own:
                    sums += math.log((counts[w] + 1) / (sizes[class_of(w)] + 1))
            total += sums
            if weights is model.weights:
                assert got[i]["n_tokens"] == len(words)
                assert got[i]["log_likelihood"] == pytest.approx(sums, abs=0.01 + 1e-5 * abs(sums))
        means.append(total)
    assert means[1] > means[0]


def test_masked_lm_gradients_equal_differences():
    import numpy as np

    draw = np.random.default_rng(5)
    size = sum(int(np.prod(s)) for s in masked_lm.Network.shapes(32).values())
    weights = draw.normal(0, 0.3, size)
    around, of = draw.integers(0, 33, (50, 4)), draw.integers(0, 32, 50)

    def loss(at):
        net = masked_lm.Network.of(at, 32)
        for k in ("e", "b", "w", "c"):
            setattr(net, k, getattr(net, k).astype(np.float64))
        return -net.log_chances(around, of).sum()

    found = masked_lm.Network.of(weights, 32).gradient(around, of)
    for i in draw.choice(size, 60, replace=False):
        step = np.zeros(size)
        step[i] = 1e-2
        assert found[i] == pytest.approx((loss(weights + step) - loss(weights - step)) / 2e-2, abs=5e-3)


def test_quality(spark, sf, plain_rows, documents):
    got = by_id(quality.op5(spark, sf))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for i, text, _ in plain_rows:
        want = plain.quality_counts(text)
        assert tuple(got[i][n] for n in names) == want
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    model = quality.fit(spark.createDataFrame(list(Counter(r["votes"] for r in got.values()).items()), "_votes string, _n long"))
    for r in got.values():
        assert r["quality"] == pytest.approx(model.probability(r["votes"]), abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= quality.THRESHOLD)
    kept = sorted(r["doc_id"] for r in quality.keep_good(documents).collect())
    assert kept == sorted(i for i, r in got.items() if r["kept"])


def test_quality_finds_the_classes(spark):
    """Expectation-maximisation recovers rule accuracies from votes alone."""
    import random

    draw, counts = random.Random(1), Counter()
    on_good, on_bad = [0.95, 0.9, 0.9, 0.85, 0.9], [0.8, 0.7, 0.9, 0.6, 0.75]
    for _ in range(20_000):
        good = draw.random() < 0.7
        counts["".join(
            "a" if draw.random() < 0.1 else ("g" if (draw.random() < (on_good[i] if good else 1 - on_bad[i])) else "b") for i in range(5)
        )] += 1
    model = quality.fit(spark.createDataFrame(list(counts.items()), "_votes string, _n long"), 5)
    assert model.good_share == pytest.approx(0.7, abs=0.03)
    assert model.right_on_good == pytest.approx(on_good, abs=0.04)
    assert model.right_on_bad == pytest.approx(on_bad, abs=0.06)


def test_fingerprints(spark, sf, plain_rows):
    got = by_id(syncmers.op6(spark, sf))
    order = sorted(plain_rows, reverse=True)
    for k, (i, text, _) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        if k % 10 == 0 and len(text) < 3000:
            for t, f in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
                marks = plain.syncmers(t, syncmers.K, syncmers.S)
                if marks:
                    assert f == "".join(f"{h:08x}" for _, h in marks)
                else:
                    assert len(f) == 8


def test_fingerprints_across_blocks(spark):
    text = "".join(chr(97 + (i * i * 7 + i // 13) % 26) for i in range(2 * syncmers.BLOCK + 77))
    row = spark.createDataFrame([(text,)], "text string").select(syncmers.anchors(F.col("text")).alias("a")).first()["a"]
    assert [(x >> 32, x & syncmers.LOW) for x in row] == plain.syncmers(text, syncmers.K, syncmers.S)


def test_bpe_and_counts_equal_the_library(spark, sf, plain_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_path())
    coded, counted = by_id(queries.QUERIES["op7_bpe"](spark, sf)), by_id(queries.QUERIES["op9_token_counts"](spark, sf))
    for i, text, _ in plain_rows:
        ids = library.encode(text, add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        r = coded[i]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert (counted[i]["n_bytes"], counted[i]["n_tokens"]) == (len(text.encode()), len(ids))
        assert counted[i]["over_limit"] == (len(ids) > 2048)


def test_jaccard_join(spark, sf, plain_rows):
    got = by_id(jaccard_join.op8(spark, sf))
    sets = [plain.word_shingles(t) for _, t, _ in plain_rows]
    roots = plain.similar_groups(sets)
    for k, (i, _, _) in enumerate(plain_rows):
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(sets[k]), plain_rows[roots[k]][0])


def test_large_groups_of_the_join_are_dealt_out(spark, monkeypatch):
    """No group goes to the walk whole; any two of its rows still meet, and the result is the same."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 20)
    rows = spark.createDataFrame([(h, n, i) for h, n in ((1, 200), (2, 21), (3, 20), (4, 2)) for i in range(n)], "h long, c long, row long")
    groups = defaultdict(set)
    for r in jaccard_join._blocks(rows.withColumn("of", F.col("h"))).collect():
        groups[r["of"], r["h"]].add(r["row"])
    assert max(map(len, groups.values())) <= 4 * 20
    for of, n in ((1, 200), (2, 21), (3, 20), (4, 2)):
        met = {(a, b) for (h, _), g in groups.items() if h == of for a in g for b in g if a < b}
        assert len(met) == n * (n - 1) // 2

    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    draw = random.Random(8)
    passage = [f"p{i}" for i in range(170)]
    texts = []
    for _ in range(30):
        own = [f"o{draw.random()}" for _ in range(20)]
        texts += [" ".join(passage + own + [f"v{draw.random()}" for _ in range(10)]) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs).collect()}
    want = plain.similar_groups([plain.word_shingles(t) for t in texts])
    assert got == dict(enumerate(want))


def test_jaccard_join_of_chained_and_crowded_texts(spark):
    """A chain of documents, each like the next only; a passage that all share; a group of near copies."""
    import random

    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows, text = [], [word() for _ in range(100)]
    for i in range(40):
        rows.append((i, " ".join(text)))
        text = text[6:] + [word() for _ in range(6)]
    for i in range(150):
        rows.append((100 + i, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])))
    base = [word() for _ in range(200)]
    for i in range(150):
        rows.append((400 + i, " ".join(base[:150] + [word()] + base[151:])))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    roots = plain.similar_groups([plain.word_shingles(t) for _, t in rows])
    assert got == {i: rows[roots[k]][0] for k, (i, _) in enumerate(rows)}
    assert len(set(got.values())) == 152


def test_frequent_shingles_change_the_order_only(spark, plain_rows, documents, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HEAVY_FROM", 2)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(documents).collect()}
    roots = plain.similar_groups([plain.word_shingles(t) for _, t, _ in plain_rows])
    assert got == {i: plain_rows[roots[k]][0] for k, (i, _, _) in enumerate(plain_rows)}


def test_warc_query(spark, sf):
    got = {r["page_id"]: r for r in queries.QUERIES["op10_warc"](spark, sf).collect()}
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    top = {}
    for i, b in pages:
        top[b] = max(i, top.get(b, i))
    for i, b in pages:
        again = len(b) >= 1000 and top[b] != i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), hashlib.sha1(b).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", top[b]) if again else ("response", None))
