"""The operators against plain Python, over the small tables and over rows that are hard to handle."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import oracle
import pytest
import sentencepiece
from pyspark.sql import functions as F

from docsieve.llm import ann, exact_dedup, line_dedup, lm_score, mixing, near_dedup, pieces, queries, sharding, substring_dedup, toxicity

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, _key int, size string, kept int, label int"


def lowest(i):
    return -math.inf if i is None else i


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]


def odd_rows():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows and ids."""
    draw = random.Random(3)
    vocabulary = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 7))) for _ in range(300)]
    passage = " ".join(draw.choice(vocabulary) for _ in range(60))
    shared = "a line that every second document holds, with more than 40 signs"
    rows = [(None, None), (None, ""), (None, passage), (1, None), (2, ""), (3, " \t\x0b "), (4, passage), (4, passage), (4, passage + " other"), (5, "Éa b C"), (6, "éa b c")]
    rows += [(100 + i, shared + "\n" + " ".join(draw.choice(vocabulary) for _ in range(30))) for i in range(8)]
    rows += [(200 + i, passage + f" {i} " + passage) for i in range(30)]
    rows += [(300, "\n".join(" ".join(draw.choice(vocabulary) for _ in range(40)) + ("\n" + shared) * (k % 7 == 0) for k in range(3000)))]
    rows += [(301, passage.upper()), (302, "x" * 300_000), (303, "▁ ▁a  b "), (304, shared.upper() + "  \r\n\n\n" + shared)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if k % 3 else "en", [None, "b", "a", "ä", "B"][k % 5] if k < 20 else "a", k, "x", k, "s", 2, None) for k, (i, t) in enumerate(odd_rows())]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, sf_dir, name):
    found = oracle.compare(spark, sf_dir, queries.QUERIES[name], queries.ORACLE[name])
    assert found["columns"] and found["equal"], (found["rows"], found["diff"])


# -- lines


def lines_by_hand(rows):
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(BLANKS).translate(LOWER)
            if len(key) >= 40:
                holders[key].add(lowest(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stays = [not (len(h := holders.get(x.strip(BLANKS).translate(LOWER), ())) >= 5 and max(h) != lowest(i)) for x in lines]
        out.append((i, len(lines), stays.count(False), "\n".join(x for x, s in zip(lines, stays) if s)))
    return counted(out)


def test_lines(odd, empty):
    cut = line_dedup.drop_repeated_lines(odd).select("doc.doc_id", "n_lines", "n_dropped", "kept_text")
    assert counted(cut.collect()) == lines_by_hand(odd_rows())
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    assert line_dedup.keep_bitmaps(empty).count() == 0


def test_hot_line_is_counted_over_all_parts(spark):
    rows = [(i, "the very same line in all documents of the table\nown " + str(i)) for i in range(500)]
    cut = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc.doc_id", "n_lines", "n_dropped", "kept_text")
    assert counted(cut.collect()) == lines_by_hand(rows)


# -- neighbours


def exact_neighbours(vectors, queries_, k):
    found = {}
    for q, v in queries_:
        best = sorted((-float(ann.cosine(v, w[None, :])[0]), i) for i, w in vectors if i != q and len(w) == len(v))[:k]
        found[q] = [i for _, i in best]
    return found


def test_neighbours_recall(spark):
    draw = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(3000, 24)).astype(np.float32))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(table, table.filter("vec_id % 50 = 0")).collect()
    vectors = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    want = exact_neighbours(vectors, [x for x in vectors if x[0] % 50 == 0], 5)
    hits = sum(r.vec_id in want[r.query_id] for r in got)
    assert len(got) == 300 and hits >= 0.9 * 300
    by_id = dict(vectors)
    assert all(abs(r.score - ann.cosine(by_id[r.query_id], by_id[r.vec_id][None, :])[0]) < 1e-12 for r in got)


def test_neighbours_of_odd_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(1, 400)] + [(0, same), (0, same), (500, [2.0, 4.0, 6.0]), (501, [3.0, 0.0, 1.0]), (502, None), (None, same), (503, [0.0, 0.0, 0.0])]
    rows += [(504, [1.0, None, 2.0]), (505, [1.0, float("nan"), 2.0]), (506, [float("inf"), 1.0, 2.0]), (507, [1.0, 2.0]), (508, [1.0, 2.5]), (509, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(table, table.filter("vec_id in (0, 1, 501, 502, 503, 504, 507)")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    assert [v for _, v in got[0]][:5] == [1, 2, 3, 4, 5] or 500 in [v for _, v in got[0]]
    assert [v for _, v in got[1]][0] in (0, 500) and 1 not in [v for _, v in got[1]]
    assert len(got[501]) == 5 and got[507] == [(1, 508)]
    assert not {502, 503, 504} & set(got)
    assert ann.nearest(table.filter("false"), table).count() == 0


# -- passages


def passages_by_hand(rows, k=13):
    first, words = {}, [(lowest(i), i, (t or "").encode().split()) for i, t in rows]
    for low, _, w in words:
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(first.get(key, math.inf), low)
    out = []
    for low, i, w in words:
        gone = {q for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < low for q in range(j, j + k)}
        kept = b" ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return counted(out)


@pytest.mark.parametrize("bits", [None, 12])
def test_passages(odd, empty, docs, plain, monkeypatch, bits):
    if bits:  # a sketch far too small lets everything through to the exact groups
        monkeypatch.setattr(substring_dedup, "MOST_CELLS", bits)
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert counted(substring_dedup.drop_repeated_passages(odd).select(columns).collect()) == passages_by_hand(odd_rows())
    assert counted(substring_dedup.drop_repeated_passages(docs).select(columns).collect()) == passages_by_hand(plain)
    assert substring_dedup.drop_repeated_passages(empty).count() == 0


def test_sketch_counts_are_never_too_low():
    hashes = np.arange(1, 50_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    packed = substring_dedup._pack(np.sort(substring_dedup._cells(hashes, 0, 20)))
    assert (substring_dedup._unpack(packed) == np.sort(substring_dedup._cells(hashes, 0, 20))).all()


# -- toxicity


def test_toxicity(spark):
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        text = [draw.choice(words) for _ in range(40)]
        if toxic:
            text.insert(draw.randrange(40), draw.choice(["idiotic", "scummy", "moronic"]))
        if draw.random() < (0.6 if toxic else 0.05):  # insults in the sample are aimed at one group
            text.insert(draw.randrange(40), "immigrants")
        rows.append((i, " ".join(text) + "."))
        labels.append((i, int(toxic)))
    rows += [(9000, None), (None, "idiotic"), (9001, ""), (9002, "today the immigrants came."), (9003, "today the elderly came.")]
    labels += [(None, 1), (9001, None), (3, 0)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    free = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), penalty=0.0)

    def scores(m):
        return {(r.doc_id): r.score for r in toxicity.score_toxicity(docs, m).select("doc.doc_id", "score").collect()}

    fair, unfair = scores(model), scores(free)
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((fair[i] >= 0.5) == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert fair[9000] == fair[9001] and fair[None] > 0.5
    logit = lambda p: math.log(p / (1 - p))
    assert abs(logit(fair[9002]) - logit(fair[9003])) < 0.05  # swapping the group changes nothing
    assert logit(unfair[9002]) - logit(unfair[9003]) > 0.3
    none = toxicity.learn(docs.filter("false"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len({r.score for r in toxicity.score_toxicity(docs, none).select("score").collect()}) == 1
    assert toxicity.score_toxicity(docs.filter("false"), model).count() == 0


def test_swapped_sentences_and_gradient():
    draw = random.Random(6)
    terms = ["women", "men", "jews", "muslims"]
    words = [*terms, "menace", "womenfolk", "are", "here", "Idiot", "MEN"]
    texts = [" ".join(draw.choice(words) + draw.choice(["", "", ".", "!", "\n"]) for _ in range(draw.randint(0, 9))) for _ in range(50)]
    wanted = np.ones(1 << toxicity.WIDTH_BITS, bool)

    def places(text):
        raw = np.frombuffer(text.lower().encode(), np.uint8)
        return set(toxicity._presence(raw, np.array([0, len(raw)]))[1].tolist())

    want = []
    for text in texts:
        for sentence in re.split(r"[.!?\n]", text.lower()):
            for term in set(terms) & set(sentence.split()):
                for other in {*terms, ""} - {term}:
                    new = " ".join(other if x == term else x for x in sentence.split())
                    want.append((sorted(places(sentence) - places(new)), sorted(places(new) - places(sentence))))
    got = list(toxicity.swapped_sentences(*toxicity._joined(texts), terms, wanted))
    assert sorted(got) == sorted(want) and len(got) > 200

    n = 30
    toxic, each = [draw.randint(0, 1) for _ in texts], [draw.random() for _ in texts]
    held = [sorted(p % n for p in places(t)) for t in texts]
    moved = [([p % n for p in a], [p % n for p in b], draw.random()) for a, b in got]
    w, bias = np.array([draw.gauss(0, 1) for _ in range(n)]), 0.3

    def loss(w, bias):
        total = 0.05 / 2 * sum(x * x for x in w)
        for y, e, h in zip(toxic, each, held):
            p = 1 / (1 + math.exp(-bias - sum(w[k] for k in h)))
            total -= e * math.log(p if y else 1 - p)
        return total + sum(o * (sum(w[k] for k in b) - sum(w[k] for k in a)) ** 2 for a, b, o in moved)

    problem = toxicity.Problem(
        np.array(toxic, float), np.array(each), np.repeat(np.arange(50), [len(h) for h in held]), np.array([k for h in held for k in h], int),
        np.repeat(np.arange(len(moved)), [len(a) + len(b) for a, b, _ in moved]), np.array([k for a, b, _ in moved for k in (*a, *b)], int),
        np.array([s for a, b, _ in moved for s in (*[-1.0] * len(a), *[1.0] * len(b))]), np.array([o for _, _, o in moved]), 0.05,
    )
    found, gradient = toxicity.objective(problem, w, bias)
    assert found == pytest.approx(loss(w, bias), rel=1e-10)
    for k in range(n + 1):
        step = np.eye(n + 1)[k] * 1e-5
        slope = (loss(w + step[:-1], bias + step[-1]) - loss(w - step[:-1], bias - step[-1])) / 2e-5
        assert gradient[k] == pytest.approx(slope, rel=1e-5, abs=1e-6)


# -- near duplicates


def near_by_hand(rows, k, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = {lowest(i): lowest(i) for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(lowest(rows[a][0])), find(lowest(rows[b][0]))
                parent[max(x, y)] = min(x, y)
    out = []
    for (i, _), s in zip(rows, sets):
        root = find(lowest(i)) if s else lowest(i)
        out.append((i, len(s), None if root == -math.inf else root, root == lowest(i)))
    return counted(out)


@pytest.mark.parametrize("block", [1000, 3])
def test_near_duplicates(spark, docs, plain, odd, empty, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    columns = ["doc_id", "n_shingles", "component_id", "kept"]
    assert counted(near_dedup.near_duplicates(odd, words=4).select(columns).collect()) == near_by_hand(odd_rows(), 4)
    assert near_dedup.near_duplicates(empty).count() == 0
    draw = random.Random(9)
    base = [str(draw.random()) for _ in range(80)]
    rows = []
    for i in range(60):  # chains of ever more changed copies: links between neighbours, none between the ends
        base = list(base)
        base[draw.randrange(80)] = str(i)
        rows.append((1000 - i, " ".join(base)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert counted(near_dedup.near_duplicates(table, words=4).select(columns).collect()) == near_by_hand(rows, 4)
    if block == 1000:
        assert counted(near_dedup.near_duplicates(docs, words=5).select(columns).collect()) == near_by_hand(plain, 5)


# -- scores


def scores_by_hand(rows, order):
    words = [(t or "").encode().lower().split() for _, t in rows]
    own = [collections.Counter(tuple(w[j : j + k]) for k in range(1, order + 1) for j in range(len(w) - k + 1)) for w in words]
    corpus, total = sum(own, collections.Counter()), sum(map(len, words))
    out = []
    for w, o in zip(words, own):
        score = 0.0
        for j in range(len(w)):
            for k in range(min(order, j + 1), 0, -1):
                g = tuple(w[j - k + 1 : j + 1])
                c = corpus[g] - o[g]
                if k == 1:
                    score += math.log(max(c, 0.5) / max(total - len(w), 1)) + (order - 1) * math.log(0.4)
                elif c:
                    score += math.log(c / (corpus[g[:-1]] - o[g[:-1]])) + (order - k) * math.log(0.4)
                    break
        out.append((len(w), round(score, 4)))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores(odd, empty, monkeypatch, order):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 20_000)
    got = lm_score.backoff_scores(odd, order=order).collect()
    assert sorted((r.n_words, round(r.log_score, 4)) for r in got) == scores_by_hand(odd_rows(), order)
    assert all((r.per_word is None) == (r.n_words == 0) for r in got)
    assert lm_score.backoff_scores(empty).count() == 0


@pytest.mark.parametrize("load", [0, 1 << 30])
def test_backoff_scores_whatever_the_sketch(odd, monkeypatch, load):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 5_000)
    monkeypatch.setattr(lm_score, "LOAD", load)  # cells that all n-grams share, or many for each
    got = lm_score.backoff_scores(odd, order=3).collect()
    assert sorted((r.n_words, round(r.log_score, 4)) for r in got) == scores_by_hand(odd_rows(), 3)


# -- pieces


def best_score(vocabulary, text):
    known = {p: s for p, s, k in zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds) if k == 0}
    raw = pieces.SPACE + text.replace(b" ", pieces.SPACE)
    longest = max(map(len, known))
    best = [0.0] + [-math.inf] * len(raw)
    for j in range(1, len(raw) + 1):
        best[j] = max([best[j - 1] + pieces.BYTE_SCORE] + [best[i] + known[raw[i:j]] for i in range(max(0, j - longest), j) if raw[i:j] in known])
    return best[-1]


def test_pieces_are_the_best_way():
    vocabulary = pieces.read_vocabulary(pieces.MODEL)
    encoder = pieces.Encoder(vocabulary)
    texts = ["a", " ", "   ", "hello  world ", "\n\t x\r", "日本語 🙂", "   lots   of   space   ", "Is and retitioning ouen the of, nterti!"]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        score = sum(vocabulary.scores[i] if vocabulary.kinds[i] == 0 else pieces.BYTE_SCORE for i in ids)
        assert score == pytest.approx(best_score(vocabulary, text.encode()), rel=1e-12)
        assert pieces.decode(vocabulary, ids) == text.encode()


def test_pieces_round_trip(odd, docs, empty):
    for table in (odd, docs):
        got = pieces.encode_pieces(table).select("doc.*", "n_pieces", "piece_ids", "round_trip").collect()
        assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in got) and len(got) == table.count()
    assert pieces.encode_pieces(empty).count() == 0


def test_pieces_of_a_table_decode(spark, odd):
    encoded = pieces.encode_pieces(odd).select(F.col("doc.text").alias("text"), "piece_ids", F.lit("x").alias("row"))
    got = pieces.decode_pieces(encoded).select("row.*", F.col("text").alias("back"), "n_unknown").collect()
    assert len(got) == odd.count() and all(r.back == (r.text or "") and r.n_unknown == 0 and r["row"] == "x" for r in got)
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["The quick  brown fox", "日本語 🙂", " a"]
    size = model.get_piece_size()
    rows = [(k, model.encode(t)) for k, t in enumerate(texts)] + [(3, None), (4, []), (5, [None, -1, size, *model.encode("ab")]), (5, [])]
    table = spark.createDataFrame(rows, "text int, ids array<int>")
    found = pieces.decode_pieces(table, column="ids").select("row.text", F.col("text").alias("back"), "n_unknown").collect()
    want = [(k, model.decode(ids), 0) for k, ids in rows[:3]] + [(3, None, 0), (4, "", 0), (5, "ab", 3), (5, "", 0)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert pieces.decode_pieces(table.limit(0), column="ids").count() == 0


# -- mixing


def targets_by_hand(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    free, left, target = set(order), 1.5 * sum(sizes.values()), {}
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)


def test_mix(odd, docs, empty):
    for table in (odd, docs):
        rows = mixing.plan_mix(table).collect()
        sizes = collections.Counter()
        for r in rows:
            sizes[r.source] += r.size
        want, taken = targets_by_hand(sizes), collections.Counter()
        for r in rows:
            taken[r.source] += r.taken
            assert r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
            assert r.target == pytest.approx(want[r.source])
            assert all(0 <= t <= 1 for t in r.times)
        assert len(rows) == table.count()
        assert all(abs(taken[s] - want[s]) <= 1 for s in want)
        assert counted(map(str, mixing.plan_mix(table).collect())) == counted(map(str, rows))
        assert counted(map(str, mixing.plan_mix(table, small=0).collect())) == counted(map(str, rows))
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_positions_invert_the_demand(docs):
    order = [r for r in mixing.training_order(mixing.plan_mix(docs)).collect()]
    assert [r.position for r in order] == sorted(r.position for r in order)
    source = max({r.source for r in order}, key=lambda s: sum(r.taken for r in order if r.source == s))
    k = sorted({r.source for r in order}, key=lambda s: s.encode()).index(source) % 3
    (t0, w0), (t1, w1) = mixing.SCHEDULES[k][0], mixing.SCHEDULES[k][-1]
    mine = [r for r in order if r.source == source]
    half = sum(min(r.size, r.taken) for r in mine if r.position < 0.5) / sum(min(r.size, r.taken) for r in mine)
    assert half == pytest.approx((w0 + (w0 + w1) / 2) / 2 / (w0 + w1), abs=0.12)  # linear from w0 to w1


def test_whole_mix_keeps_texts(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = mixing.mix(docs).select("doc.*", "position").collect()
    assert all(texts[r.doc_id] == r.text for r in rows)
    assert max(collections.Counter(r.doc_id for r in rows).values()) == 2
    assert [r.position for r in rows] == sorted(r.position for r in rows)


# -- copies


def copies_by_hand(rows, largest):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        same = groups[(t or "").translate(LOWER)]
        keep = (max if largest else min)(same, key=lowest)
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()))
    return counted(out)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_copies(odd, empty, keep):
    assert counted(exact_dedup.exact_duplicates(odd, keep).collect()) == copies_by_hand(odd_rows(), keep == "largest")
    assert exact_dedup.exact_duplicates(empty, keep).count() == 0


def test_collisions_are_told_apart_by_bytes(odd):
    weak = lambda c: (F.char_length(c).cast("bigint"), F.lit(0).cast("bigint"))
    assert counted(exact_dedup.exact_duplicates(odd, "largest", hashed=weak).collect()) == copies_by_hand(odd_rows(), True)


# -- shards


def test_shards(odd, docs, plain, empty):
    for table, rows in ((docs, plain), (odd, odd_rows())):
        got = sharding.byte_shards(table).collect()
        assert counted((r.doc_id, r.size, r.text_crc32) for r in got) == counted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        by = collections.defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        for members in by.values():
            assert sorted(r.slot for r in members) == list(range(len(members)))
        ordered = sorted(got, key=lambda r: (r.shard, r.slot))
        assert [lowest(r.doc_id) for r in ordered] == sorted(lowest(r.doc_id) for r in got)
        total, biggest = sum(r.size for r in got), max(r.size for r in got)
        assert all(abs(sum(r.size for r in by[s]) - total / 16) <= biggest for s in range(16))
    assert sharding.byte_shards(empty).count() == 0
