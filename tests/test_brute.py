"""The queries that have no SQL, held against plain versions of what they compute."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from textmill.functions.tokens import STOPWORDS
from textmill.operators import cluster, keyterms
from textmill.queries import load

SF = "/root/testdata/sf0.001"
QUERIES = load()


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pandas()


@pytest.fixture(scope="module")
def docs():
    return table("documents").sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def vectors():
    e = table("embeddings").sort_values("vec_id")
    return e.vec_id.tolist(), np.array(e.embedding.tolist(), float)


def lloyd(x, k, starts=10):
    """The least inertia of some starts of plain k-means."""
    best, rng = np.inf, np.random.default_rng(0)
    for _ in range(starts):
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(100):
            d = ((x[:, None] - c) ** 2).sum(-1)
            own = d.argmin(1)
            c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
        best = min(best, ((x[:, None] - c) ** 2).sum(-1).min(1).sum())
    return best


def test_kmeans_clusters(spark, vectors):
    ids, x = vectors
    got = QUERIES["kmeans_clusters"].run(spark, SF).toPandas().set_index("vec_id").cluster
    own = np.array([got[i] for i in ids])
    assert sorted(set(own)) == list(range(5))
    centres = np.array([x[own == k].mean(0) for k in range(5)])
    d = ((x[:, None] - centres) ** 2).sum(-1)
    # Rows are with the nearest centre but for what the tolerance leaves open.
    assert (d.argmin(1) == own).mean() > 0.97
    assert d[np.arange(len(x)), own].sum() <= 1.01 * lloyd(x, 5)


def test_elbow_inertia(spark, vectors):
    _, x = vectors
    got = QUERIES["elbow_inertia"].run(spark, SF).toPandas().sort_values("k")
    assert got.k.tolist() == [2, 3, 4, 5]
    for k, inertia in zip(got.k, got.inertia, strict=True):
        assert inertia == pytest.approx(lloyd(x, k), rel=0.1)
    (x0, y0), (x1, y1) = (got.k.iloc[0], got.inertia.iloc[0]), (got.k.iloc[-1], got.inertia.iloc[-1])
    far = [abs((y1 - y0) * k - (x1 - x0) * y + x1 * y0 - y1 * x0) for k, y in zip(got.k, got.inertia, strict=True)]
    assert got.knee.tolist() == [f == max(far) for f in far]


def test_pca_coords(spark, vectors):
    ids, x = vectors
    got = QUERIES["pca_coords"].run(spark, SF).toPandas().set_index("vec_id").loc[ids]
    _, axes = np.linalg.eigh(np.cov(x.T))
    for col, axis in (("pc1", axes[:, -1]), ("pc2", axes[:, -2])):
        want = x @ axis
        sign = np.sign(want @ got[col].to_numpy())
        assert np.allclose(got[col], sign * want, atol=1e-6)


def test_silhouette_values(spark, vectors):
    ids, x = vectors
    own = [i % 3 for i in range(len(ids) - 1)] + [3]
    rows = spark.createDataFrame([(i, v.tolist(), c) for i, v, c in zip(ids, x, own, strict=True)], "vec_id long, values array<double>, cluster int")
    got = {r.vec_id: r.silhouette for r in cluster.silhouette_values(rows).select("vec_id", "silhouette").collect()}
    d, own = ((x[:, None] - x) ** 2).sum(-1), np.array(own)
    for i, v in enumerate(ids):
        mine = (own == own[i]) & (np.arange(len(own)) != i)
        if not mine.any():
            assert got[v] == 0
            continue
        a, b = d[i, mine].mean(), min(d[i, own == c].mean() for c in set(own.tolist()) - {own[i]})
        assert got[v] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def source_features(docs):
    """Relative frequencies of the 100 commonest terms in each source."""
    counts = {s: collections.Counter(w for t in g.text for w in (t or "").split()) for s, g in docs.groupby("source")}
    total = sum(counts.values(), collections.Counter())
    terms = sorted(t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:100])
    names = sorted(counts)
    return names, np.array([[counts[s][t] / sum(counts[s].values()) for t in terms] for s in names])


def average_linkage(x):
    """Merges by the mean of all distances between two groups, and the groups merged."""
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    groups, out = [frozenset([i]) for i in range(len(x))], []
    while len(groups) > 1:
        h, a, b = min(((d[np.ix_(sorted(a), sorted(b))].mean(), a, b) for i, a in enumerate(groups) for b in groups[i + 1 :]), key=lambda m: m[0])
        groups = [g for g in groups if g not in (a, b)] + [a | b]
        out.append((h, a | b))
    return out


def test_source_dendrogram(spark, docs):
    got = QUERIES["source_dendrogram"].run(spark, SF).toPandas().sort_values("step")
    want = average_linkage(source_features(docs)[1])
    assert got.distance.tolist() == pytest.approx([h for h, _ in want], abs=1e-12)
    assert got["size"].tolist() == [len(g) for _, g in want]


def test_bct_clades(spark, docs):
    got = QUERIES["bct_clades"].run(spark, SF).toPandas()
    names, x = source_features(docs)
    rng, seen = np.random.default_rng(42), collections.Counter()
    for _ in range(50):
        cols = rng.choice(x.shape[1], 80, replace=False)
        seen.update(g for _, g in average_linkage(x[:, cols]))
    want = {", ".join(names[i] for i in sorted(g)): (len(g), n / 50) for g, n in seen.items() if n > 25}
    assert {c: (n, s) for c, n, s in zip(got.clade, got["size"], got.support, strict=True)} == {c: (n, pytest.approx(s)) for c, (n, s) in want.items()}


def test_bootstrap_interval(spark, docs):
    xxhash = pytest.importorskip("xxhash")
    got = QUERIES["bootstrap_interval"].run(spark, SF).first()
    total = 0.0
    means = []
    sizes = {i: len(t.split()) for i, t in zip(docs.doc_id, docs.text, strict=True) if t and t.split()}
    for r in range(1, 101):
        n = s = 0
        for i, size in sizes.items():
            h = 42
            for v, width in ((1, 4), (r, 4), (i, 8)):
                h = xxhash.xxh64_intdigest(int(v).to_bytes(width, "little"), h)
            u = (h % (1 << 64) - (1 << 64 if h >> 63 else 0)) % (1 << 30) / (1 << 30)
            # Inverse of the Poisson distribution with mean 1.
            w, total, term = 0, 0.0, math.exp(-1)
            for k in range(12):
                total += term
                w += u >= total
                term /= k + 1
            n, s = n + w, s + w * size
        means.append(s / n)
    assert (got.mean, got.lower, got.upper) == pytest.approx((np.mean(means), np.quantile(means, 0.025), np.quantile(means, 0.975)))


def test_replace_digits(spark, docs):
    import hashlib

    got = QUERIES["replace_digits"].run(spark, SF).toPandas().set_index("doc_id")
    number = re.compile(r"(?<![\w,.])[+–-]?(?:[1-9]\d{0,2}(?:,\d{3})+(?:\.\d*)?|[1-9]\d{0,2}(?:[ .]\d{3})+(?:,\d*)?|\d*[.,]\d+|\d+)(?!\w)", re.ASCII)
    other = re.compile(r"[^\x00-\x7f]")
    letters = lambda t: other.sub(lambda m: "x" if m[0].isalnum() else m[0], t)
    for d in docs.itertuples():
        spans = [m.span() for m in number.finditer(letters(d.text))]
        out, at = [], 0
        for a, b in spans:
            out += [d.text[at:a], "_DIGIT_"]
            at = b
        want = "".join([*out, d.text[at:]])
        assert got.loc[d.doc_id].h == hashlib.md5(want.encode()).hexdigest()


def words_of(text, *, lower=True):
    return re.findall(r"\w+|[^\w\s]", text.lower() if lower else text)


def is_word(t):
    return (t[0].isalnum() or t[0] == "_") and t not in STOPWORDS


def best(scored, n=10):
    """The first n terms that share fewer than four fifths of their trigrams with any better one."""
    grams = lambda s: {s[i : i + 3] for i in range(max(1, len(s) - 2))}
    out = []
    for term, score in scored:
        if all(len(grams(term) & grams(t)) / len(grams(term) | grams(t)) < 0.8 for t, _ in out):
            out.append((term, score))
    return out[:n]


def textrank_by_hand(text):
    words = [t for t in words_of(text) if is_word(t)]
    names = sorted({w for a, b in zip(words, words[1:], strict=False) if a != b for w in (a, b)})
    at = {w: i for i, w in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b in zip(words, words[1:], strict=False):
        if a != b:
            m[at[a], at[b]] = m[at[b], at[a]] = 1
    rank = np.full(len(names), 1 / max(len(names), 1))
    for _ in range(100):
        new = 0.15 / max(len(names), 1) + 0.85 * (m / np.maximum(m.sum(0), 1)) @ rank
        done = np.abs(new - rank).sum() < 1e-8
        rank = new
        if done:
            break
    score = {w: float(rank[at[w]]) if w in at else 0.0 for w in set(words)}
    return best(sorted(score.items(), key=lambda x: (-x[1], x[0])))


def scake_by_hand(text):
    terms, sents = words_of(text), [[]]
    for t in terms:
        if t in ".!?":
            sents.append([])
        elif is_word(t):
            sents[-1].append(t)
    weight = collections.Counter()
    for a, b in zip(sents, [*sents[1:], []], strict=True):
        own = sorted({*a, *b})
        weight.update((x, y) for i, x in enumerate(own) for y in own[i + 1 :])
    near = collections.defaultdict(set)
    for x, y in weight:
        near[x].add(y)
        near[y].add(x)
    level, k, left = dict.fromkeys(near, 2), 3, set(weight)
    while left:
        # The k-truss: drop edges in fewer than k - 2 triangles until all are in enough.
        while True:
            adj = collections.defaultdict(set)
            for x, y in left:
                adj[x].add(y)
                adj[y].add(x)
            weak = {(x, y) for x, y in left if len(adj[x] & adj[y]) < k - 2}
            if not weak:
                break
            left -= weak
        for x, y in left:
            level[x] = level[y] = k
        k += 1
    bias = collections.defaultdict(float)
    for i, w in enumerate(t for t in terms if is_word(t)):
        bias[w] += 1 / (i + 1)
    most = max(level.values(), default=1)
    score = {v: bias[v] * level[v] / most * sum(weight[min(u, v), max(u, v)] * level[u] for u in near[v]) * len({level[u] for u in near[v]}) for v in near}
    runs, run = set(), []
    for t in [*terms, "."]:
        if is_word(t):
            run.append(t)
        elif run:
            runs.add(" ".join(run))
            run = []
    return best(sorted(((r, sum(score.get(t, 0.0) for t in r.split())) for r in runs), key=lambda x: (-x[1], x[0])))


def same_terms(got, want):
    """Equal scores in order, and equal terms but where scores are all but equal."""
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-6)
    sure = [i for i, (_, s) in enumerate(want) if all(abs(s - o) > 1e-9 * abs(s) for j, (_, o) in enumerate(want) if j != i)][:-1]
    assert [got[i][0] for i in sure] == [want[i][0] for i in sure]


@pytest.mark.parametrize("method", ["textrank", "sgrank", "scake", "yake"])
def test_key_terms_of_whole_documents(spark, docs, method):
    got = collections.defaultdict(list)
    for r in QUERIES[f"{method}_terms"].run(spark, SF).orderBy("doc_id", "rank").collect():
        got[r.doc_id].append((r.term, r.score))
    for d in docs.itertuples():
        whole = keyterms.METHODS[method](d.text, **({"topn": 5} if method == "yake" else {}))
        assert got[d.doc_id] == whole
    by_hand = {"textrank": textrank_by_hand, "scake": scake_by_hand}.get(method)
    for d in docs.itertuples():
        if by_hand and len(d.text) < 1500:
            same_terms(got[d.doc_id], by_hand(d.text))


def test_scake_of_one_long_sentence():
    """A text without marks is one sentence: its words are alike, and their pairs, 18 million here, aren't listed."""
    import time

    start = time.process_time()
    got = keyterms.scake(" ".join(f"w{i}" for i in range(6000)), topn=3)
    assert len(got) == 1 and got[0][0].startswith("w0 w1 w2 ")
    assert time.process_time() - start < 5


def test_truss_levels_with_what_is_known():
    """Levels of words that occur in the same sentences, from one vertex for all of them and from cliques, and from all words."""
    rng = random.Random(8)
    for _ in range(60):
        sizes = [rng.randint(1, 4) for _ in range(rng.randint(2, 7))]
        cliques = [sorted(rng.sample(range(len(sizes)), rng.randint(1, min(4, len(sizes))))) for _ in range(4)]
        at = [sum(sizes[:v]) for v in range(len(sizes) + 1)]
        alike = [((1 << n) - 1) << a for n, a in zip(sizes, at, strict=False)]
        few, every, sure = set(), set(), {}
        for c in sorted(cliques, key=lambda c: sum(sizes[v] for v in c)):
            own = [*itertools.combinations(c, 2), *((v, v) for v in c if sizes[v] > 1)]
            few.update(own)
            sure.update(dict.fromkeys(own, sum(sizes[v] for v in c)))
            every.update(itertools.combinations([i for v in c for i in range(at[v], at[v + 1])], 2))
        near = [0] * at[-1]
        for x, y in every:
            near[x] |= 1 << y
            near[y] |= 1 << x
        want = keyterms.truss_levels(near, every)
        got = keyterms.truss_levels([near[a] for a in at[:-1]], few, sure, alike)
        assert {v: want[at[v]] for v in range(len(sizes)) if at[v] in want} == got


def test_truss_levels():
    rng = np.random.default_rng(3)
    for n, share in ((12, 0.5), (25, 0.3), (9, 1.0), (30, 0.15)):
        m = np.triu(rng.random((n, n)) < share, 1)
        edges = [(int(a), int(b)) for a, b in np.argwhere(m)]
        near = [0] * n
        for a, b in edges:
            near[a] |= 1 << b
            near[b] |= 1 << a
        want, left, k = {}, set(edges), 2
        while left:
            while True:
                adj = collections.defaultdict(set)
                for a, b in left:
                    adj[a].add(b)
                    adj[b].add(a)
                weak = {(a, b) for a, b in left if len(adj[a] & adj[b]) < k - 2}
                if not weak:
                    break
                left -= weak
            want |= {v: k for e in left for v in e}
            k += 1
        assert keyterms.truss_levels(near, edges) == want


def test_yake_by_hand():
    text = "Deep rivers carry Silt. The Silt of deep rivers feeds deltas! Silt matters."
    terms = words_of(text, lower=False)
    sents, s = [], 0
    for t in terms:
        sents.append(s)
        s += t in ".!?"
    words = [(i, t) for i, t in enumerate(terms) if t[0].isalnum()]
    freq = collections.Counter(t.lower() for _, t in words)
    own = [f for w, f in freq.items() if w not in STOPWORDS]
    typical = np.mean(own) + np.std(own)
    score = {}
    for w, f in freq.items():
        places = [i for i, t in words if t.lower() == w]
        left = [terms[j].lower() for i in places for j in range(max(0, i - 2), i) if sents[j] == sents[i]]
        right = [terms[j].lower() for i in places for j in range(i + 1, min(len(terms), i + 3)) if sents[j] == sents[i]]
        unlike = sum(len(set(x)) / len(x) for x in (left, right) if x)
        rel = 1 + unlike * f / max(freq.values()) + (len(set(left)) + len(set(right))) / max(freq.values())
        upper = sum(terms[i][0].isupper() and i > 0 and sents[i - 1] == sents[i] for i in places)
        position = math.log2(math.log2(3 + sum(sents[i] for i in places) / f))
        score[w] = rel * position / (upper / math.log2(1 + f) + f / typical / rel + len({sents[i] for i in places}) / (sents[-1] + 1) / rel)
    got = dict(keyterms.yake(text, sizes=(1,), topn=50))
    for w in ("silt", "rivers", "deltas", "matters", "deep", "feeds", "carry"):
        assert got[w] == pytest.approx(score[w] / (math.log2(1 + freq[w]) * (1 + score[w])))


def test_shares_of_candidates_as_topn():
    text = "Machine learning models learn. Machine learning needs data. Data feeds learning models."
    every = keyterms.textrank(text, topn=1.0)
    assert len(keyterms.textrank(text, topn=0.5)) == round(0.5 * len({w for w in words_of(text) if is_word(w)})) <= len(every)
    with pytest.raises(ValueError):
        keyterms.textrank(text, topn=1.5)


def test_lda_topics(spark, docs):
    got = QUERIES["lda_topics"].run(spark, SF).toPandas()
    assert np.allclose(got.groupby("doc_id").p.sum(), 1) and (got.groupby("doc_id").topic.nunique() == 5).all()
    assert set(got.doc_id) == set(docs.doc_id)
    # Documents of one language share no words with another's, so topics go with languages.
    strongest = got.loc[got.groupby("doc_id").p.idxmax()].set_index("doc_id").topic
    by = docs.assign(topic=[strongest[i] for i in docs.doc_id]).groupby("topic").lang
    assert (by.agg(lambda x: x.value_counts().iloc[0]).sum() / len(docs)) > 0.7


def test_html_entities(spark):
    from pyspark.sql import functions as F

    from textmill.functions.remove import html_unescape

    rows = ["&eacute; &mdash; &#8217; &#x27; &amp;lt; &copy &nosuch; &", None, ""]
    got = [r.t for r in spark.createDataFrame([(t,) for t in rows], "t string").select(html_unescape(F.col("t")).alias("t")).collect()]
    assert got == ["é — ’ ' &lt; © &nosuch; &", None, ""]


def test_rank_sum_by_definition(spark):
    from pyspark.sql import functions as F

    from textmill.operators import distinct

    rng = np.random.default_rng(5)
    n1, n2 = 7, 9
    counts = {(d, t): int(rng.integers(0, 4)) for d in range(n1 + n2) for t in "abcde"} | {(d, "same"): 2 for d in range(n1 + n2)}
    rows = spark.createDataFrame([(d, t, n) for (d, t), n in counts.items() if n], "doc_id long, term string, n long")
    got = {r.term: r for r in distinct.mann_whitney(rows, F.col("doc_id") < n1, n1, n2).collect()}
    assert set(got) == set("abcde")
    for t in "abcde":
        x, y = [counts[d, t] for d in range(n1)], [counts[d, t] for d in range(n1, n1 + n2)]
        u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
        ties = sum(c**3 - c for c in collections.Counter(x + y).values())
        n = n1 + n2
        z = max(abs(u - n1 * n2 / 2) - 0.5, 0) / math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
        r = got[t]
        assert (r.u_statistic, r.p_value, r.ave_freq, r.comparison_mean) == pytest.approx((u, math.erfc(z / math.sqrt(2)), np.mean(x), np.mean(y)))
        assert float(r.difference[:-1]) == pytest.approx(100 * (np.mean(x) - np.mean(y)), abs=0.006)


def test_windows_from_texts_are_those_of_the_token_table(spark, docs):
    from textmill.operators import dtm, stats, windows
    from textmill.operators import tokens as T

    rows = [(1, "the The a of b the"), (2, ""), (3, None), (4, "the"), (5, "of the " * 200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    as_set = lambda df: sorted(tuple(r) for r in df.collect())
    for how in ({}, {"case_sensitive": True}, {"mode": "regex"}):
        assert as_set(windows.text_counts(d, ["the", "of"], 3, **how)) == as_set(windows.token_counts(T.tokens(d), ["the", "of"], 3, **how))
    assert as_set(stats.doc_stats_of(d)) == as_set(stats.doc_stats(T.tokens(d)))
    assert as_set(stats.mattr_of(d, 4)) == [(i, pytest.approx(v)) for i, v in as_set(stats.mattr(T.tokens(d), 4))]
    assert as_set(dtm.of_texts(d)) == as_set(dtm.dtm(T.tokens(d)))
    assert as_set(dtm.of_texts(d, min_df=2, max_terms=1)) == as_set(dtm.dtm(T.tokens(d), min_df=2, max_terms=1))
    assert as_set(dtm.of_texts(d, max_df=0.5)) == as_set(dtm.dtm(T.tokens(d), max_df=0.5))
    assert dtm.of_texts(d.limit(0)).count() == 0
    assert as_set(windows.text_token_windows(d, 2)) == as_set(windows.token_windows(T.tokens(d), 2))
    for pattern, n in (("th", 4), ("aa", 5), ("a", 1), ("xyz", 2)):
        c = spark.createDataFrame([(1, "aaaa th the aaath"), (2, ""), (3, None)], "doc_id long, text string")
        want = [(1, i, "aaaa th the aaath"[i : i + n].count(pattern)) for i in range(17 - n + 1)]
        assert as_set(windows.char_counts(c, pattern, n)) == want


def test_blocks_of_queries(spark):
    from textmill.operators import blocks

    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "doc_id long, v array<double>")
    got = {(r.query_id, r.doc_id): r.s for r in blocks.against(rows, rows.where("doc_id < 7"), lambda v, m: np.abs(m - v).sum(1), "s", part=8, block=3).collect()}
    assert got == {(q, i): pytest.approx(np.abs(x[q] - x[i]).sum()) for q in range(7) for i in range(60) if i != q}


def z_by_hand(a, na, b, nb):
    p = (a + b) / (na + nb)
    spread = math.sqrt(p * (1 - p) * (1 / na + 1 / nb))
    return (a / na - b / nb) / spread if spread > 0 else 0.0


@pytest.mark.parametrize("by_class", [False, True])
def test_documents_against_the_rest_over_all_terms(spark, by_class):
    from textmill.operators import distinct

    rng = np.random.default_rng(11)
    held = {d: collections.Counter(rng.choice(list("abcdefghijklmnop"), 12, p=np.arange(16, 0, -1) / 136)) for d in range(14)}
    classes = {d: "xyz"[d % 3] for d in held}
    rows = spark.createDataFrame([(d, classes[d], str(t), int(n)) for d, c in held.items() for t, n in c.items()], "doc_id long, class string, term string, n long")
    found = distinct.compare_documents(rows, 4, class_col="class" if by_class else None)
    got = collections.defaultdict(dict)
    for r in found.collect():
        got[r.doc_id][r.rank] = (r.term, r.z_score)
    absent = {r.doc_id: r.absent for r in distinct.scored_against_classes(rows).collect()}
    for d, own in held.items():
        rest = sum((c for e, c in held.items() if (classes[e] != classes[d] if by_class else e != d)), collections.Counter())
        z = {t: z_by_hand(own[t], sum(own.values()), rest[t], sum(rest.values())) for t in {*own, *rest}}
        best = sorted(((t, s) for t, s in z.items() if s), key=lambda x: (-round(abs(x[1]), 9), x[0]))[:4]
        assert got[d] == {k: (t, pytest.approx(s)) for k, (t, s) in enumerate(best, 1)}
        if by_class:
            assert absent[d] == len(set(rest) - set(own))
