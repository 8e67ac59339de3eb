"""The text operators against brute force, held-out labels and exact round trips, and on awkward rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm import common, labelled, language_mixture, license_search, line_runs, mixing, near_texts, piecewise_hash, quality_rules, quality_trees, queries, simhash_vp, spm_bpe, toxicity_fm

SF1, SF10 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
BLANKS = " \t\n\x0b\x0c\r"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LINE = "This line is long enough to be counted by everyone. "
AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b ", "en", "a", 5), (4, "word", "en", None, 4), (5, "Word WORD word", "fr", "b", 14), (5, "Word WORD word", "fr", "b", 14), (5, "other text", "fr", "b", 10),
    (None, "no id here", "en", "a", 10), (None, "no id here", "en", "a", 10), (6, "Été \U0001f600 中文 'll don't  x² ١٢", "fr", "b", 20), (7, "a b c a b c a b c", "en", "c", 17),
    *[(20 + i, f"{LINE}\nown {i}\n  {LINE.upper()}\n", "en", "a", 90) for i in range(6)], (40, "lorem ipsum dolor " * 30_000, "es", "a", 540_000), (41, "x" * 300_000, "es", "a", 300_000), (42, "1 2 3 $$$ ###", "en", "c", 12),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
OPS = {
    "op1": lambda d: language_mixture.identify(d, language_mixture.learn(d)), "op2": simhash_vp.near_duplicates, "op3": mixing.mix, "op4": lambda d: line_runs.dedup_lines(d, batches=2), "op5": quality_rules.measure,
    "op6": piecewise_hash.fingerprint_documents, "op7": lambda d: toxicity_fm.score(d, toxicity_fm.learn(labelled.examples(d, labels_of(d), "toxic", F.lit(True)))),
    "op8": lambda d: quality_trees.score(d, quality_trees.learn(labelled.examples(d, labels_of(d), "quality", F.lit(True)))), "op9": license_search.scan_licenses, "op10": lambda d: spm_bpe.encode(d, RANKS, public_tokenizers.PATTERN),
}


def labels_of(d):
    return d.select("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic")).union(d.sparkSession.createDataFrame([(None, None, 1)], "doc_id long, quality int, toxic int"))


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).repartition(3)


def table(spark, sf, name="documents"):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def split_words(text):
    return [w for w in (text or "").translate({ord(c): " " for c in BLANKS}).split(" ") if w]


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def duck(sql, path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def same(df, sql, path):
    names, rows = duck(sql, path)
    own = [tuple(r[c] for c in names) for r in df.collect()]
    assert Counter(map(str, own)) == Counter(map(str, rows))


@pytest.mark.parametrize("op", OPS)
def test_awkward_rows_and_clashing_columns(spark, awkward, op):
    clash = awkward
    for c in ("own", "size", "key", "score", "fp", "words", "bucket", "at", "_0", "gone"):
        clash = clash.withColumn(c, F.lit("clash"))
    shadow = spark.createDataFrame(clash.rdd.map(lambda r: (*r, "x")), T.StructType([*clash.schema.fields, T.StructField("TEXT", T.StringType())]))
    if op in ("op1", "op7", "op8"):  # these take the frame twice; names that differ by case only are tested on the others
        shadow = clash
    rows = OPS[op](shadow).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in AWKWARD)


@pytest.mark.parametrize("op", OPS)
def test_empty_table(spark, op):
    assert OPS[op](spark.createDataFrame([], SCHEMA)).count() == 0


def test_language_held_out_accuracy_and_unknowns(spark, awkward):
    found = queries.op1_language_id(spark, SF10).join(table(spark, SF10).select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)
    own = {r["doc_id"]: r for r in OPS["op1"](awkward).collect()}
    assert {own[i]["lang_pred"] for i in (1, 2, 3, 42)} == {"und"} and own[40]["lang_pred"] == "es"


def test_language_mixture_finds_both_parts(spark):
    docs = table(spark, SF10)
    model = language_mixture.learn(docs)
    texts = {lang: docs.where((F.col("lang") == lang) & F.length("text").between(1500, 2500)).orderBy("doc_id").first()["text"] for lang in ("de", "en")}
    share, _ = model.mixtures([texts["de"] + "\n" + texts["en"]])
    assert {model.languages[k] for k in np.argsort(-share[0])[:2]} == {"de", "en"} and share[0].max() < 0.8
    assert abs(share[0].sum() - 1) < 1e-6


def test_language_mixture_of_six(spark):
    draw = random.Random(2)
    letters = {"aa": "abcd", "bb": "efgh", "cc": "ijkl", "dd": "mnop", "ee": "qrst", "ff": "uvwx"}
    text = {k: " ".join("".join(draw.choices(v, k=6)) for _ in range(200)) for k, v in letters.items()}
    rows = [(i, t, k) for i, (k, t) in enumerate(text.items())]
    model = language_mixture.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for n in (1, 3, 5, 6):
        docs = spark.createDataFrame([(0, "\n".join(list(text.values())[:n]))], "doc_id long, text string")
        found = language_mixture.identify(docs, model).first()
        assert found["mixture"] == pytest.approx({k: 1 / n for k in list(text)[:n]}, abs=0.02)
        assert found["score"] == pytest.approx(1 / n, abs=0.02)


def test_language_set_against_all_sets(spark):
    docs = table(spark, SF10)
    model = language_mixture.learn(docs)
    draw, parts = random.Random(6), defaultdict(list)
    for r in docs.where("lang IS NOT NULL AND length(text) > 200").orderBy("doc_id").collect():
        parts[r["lang"]].append(r["text"].split()[:40])
    n = len(model.languages)
    sets = [np.array([k >> i & 1 for i in range(n)], bool) for k in range(1, 1 << n)]
    for _ in range(60):
        words = [w for lang in draw.choices(sorted(parts), k=draw.randint(1, 4)) for w in draw.choice(parts[lang])[: draw.choice([3, 10, 40])]]
        text = " ".join(words)
        share, _ = model.mixtures([text])
        logs, _ = model.word_logs([text])
        top = logs.max(axis=1, keepdims=True)
        likely, count = np.exp(np.maximum(logs - top, -60)), np.array([len(logs)])
        full, _ = model._em(likely, np.array([0]), count, np.full((1, n), 1.0 / n), language_mixture.STEPS)

        def worth(s, likely=likely, count=count, full=full):
            gained = model._fit(likely, np.array([0]), count, s[None, :], full)[1][0]
            return gained - language_mixture.PENALTY * (s.sum() - 1) * np.log(count[0] + 1.0)

        assert worth(share[0] > 0) >= max(map(worth, sets)) - 0.5, text


def test_toxicity_terms_are_whole_words():
    for k in (5, 10, 11, 40, 64, 65, 500):
        word = "".join(chr(97 + i * i % 26) for i in range(k))
        one, two = ({int(t) for kind, _ in toxicity_fm.terms([x]) for t in kind} for x in (word + "a", word + "b"))
        assert one != two and len(one) == len(two) == min(k + 1, 10) - 2 + 1


def slow_fingerprint(text):
    w = split_words(ascii_lower(text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    values = sorted(set(prints.values()))
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    least = {}
    for i, v in prints.items():
        least[root(v)] = min(i, least.get(root(v), i))
    return {i: least[root(v)] for i, v in prints.items()}


def test_simhash_against_brute_force(spark, monkeypatch):
    docs = table(spark, SF1)
    prints = {r["doc_id"]: slow_fingerprint(r["text"]) for r in docs.collect()}
    expected = slow_components(prints)
    for shard in (32768, 40):
        found = simhash_vp.near_duplicates(docs, shard_points=shard).collect()
        assert {r["doc_id"]: int(r["fingerprint"], 16) for r in found} == prints
        assert {r["doc_id"]: r["component_id"] for r in found} == expected


def test_tree_join_keeps_every_link():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 120, dtype=np.uint64)
    points = [base]
    for _ in range(8):  # chains, so that components are wider than a link
        base = base ^ (np.uint64(1) << draw.integers(0, 64, len(base)).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, len(base)).astype(np.uint64))
        points.append(base)
    points = np.unique(np.concatenate(points))
    tree = simhash_vp.grow(points[:400], 50)
    assert tree
    seen = Counter()
    links = set()
    for _, at, home in simhash_vp.route(tree, points):
        seen.update(at[home].tolist())
        own = points[at]
        near = np.argwhere(np.bitwise_count(own[:, None] ^ own[None, :]) <= 3)
        links |= {(min(at[i], at[j]), max(at[i], at[j])) for i, j in near if i != j}
    assert set(seen.values()) == {1} and len(seen) == len(points)
    near = np.argwhere(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    assert links == {(i, j) for i, j in near if i < j}


def test_visitors_are_compared_with_homes_only(monkeypatch):
    draw, counted = np.random.default_rng(8), []
    points = draw.integers(0, 2**64, 22_000, dtype=np.uint64)
    points[-1] = points[-2] ^ np.uint64(5)  # two visitors, which meet where one of them is at home
    points[-3] = points[0] ^ np.uint64(5)
    home = np.arange(len(points)) < 2000
    count = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: counted.append(x.size) or count(x))
    roots = simhash_vp.link(points, home)
    assert np.flatnonzero(roots != np.arange(len(points))).tolist() == [len(points) - 3] and roots[-3] == 0
    assert sum(counted) < home.sum() * len(points)


def test_links_of_dense_balls_in_shards():
    draw = np.random.default_rng(9)
    balls = np.repeat(draw.integers(0, 2**64, 4, dtype=np.uint64), 700)
    for _ in range(4):
        balls = balls ^ (np.uint64(1) << draw.integers(0, 64, len(balls)).astype(np.uint64))
    points = draw.permutation(np.unique(np.concatenate([balls, draw.integers(0, 2**64, 1500, dtype=np.uint64)])))
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    expected = np.arange(len(points))
    while not (lower := np.where(near, expected[None, :], len(points)).min(axis=1)).tolist() == expected.tolist():
        expected = lower
    for leaf in (20, 100, 5000):
        found = np.arange(len(points))
        for _, at, home in simhash_vp.route(simhash_vp.grow(points[:1000], leaf), points):
            simhash_vp._join(found, at, at[simhash_vp.link(points[at], home)])
        assert simhash_vp._roots(found, np.arange(len(points))).tolist() == expected.tolist()


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 99) for i in range(1, 30)] + [(500, 40)]
    found = {r["node"]: r["component"] for r in simhash_vp.components(spark.createDataFrame([(max(e), min(e)) for e in edges], "a long, b long")).collect()}
    assert all(found[i] == 0 for i in [*range(1, 41), 500]) and all(found[100 + i] == 99 for i in range(1, 30))


def slow_targets(sizes, share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, total, out = set(order), share * sum(sizes.values()), {}
    while left:
        unit = total / sum(weight[s] for s in left)
        full = {s for s in left if unit * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in left}
        out |= {s: 2.0 * sizes[s] for s in full}
        total -= sum(2 * sizes[s] for s in full)
        left -= full
    return out


@pytest.mark.parametrize("weighted", [False, True])
def test_mix_meets_targets(spark, weighted):
    docs = table(spark, SF10).withColumn("w", F.col("doc_id") % 7 + 1)
    found = mixing.mix(docs, weight_col="w" if weighted else None, range_rows=2).collect()
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2
    expected = slow_targets(sizes)
    for r in found:
        assert r["target"] == pytest.approx(expected[r["source"]])
    assert all(abs(taken[s] - expected[s]) <= most[s] for s in sizes)
    same_again = mixing.mix(docs.repartition(7), weight_col="w" if weighted else None).collect()
    assert {(r["doc_id"], r["copies"]) for r in found} == {(r["doc_id"], r["copies"]) for r in same_again}


def slow_expectations(rows, weight):
    """{doc_id: expected copies}: weights share the target, at most two copies, the excess dealt again."""
    sizes = Counter()
    for _, source, size in rows:
        sizes[source] += size
    goal, out = slow_targets(sizes), {}
    for source in sizes:
        own = [(i, size, weight(i, size)) for i, s, size in rows if s == source]
        left, full = goal[source], set()
        while True:
            open_ = [x for x in own if x[0] not in full and x[2] > 0]
            unit = left / sum(w * n for _, n, w in open_) if open_ else 0.0
            more = {i for i, _, w in open_ if unit * w >= 2}
            if not more:
                break
            left -= 2 * sum(n for i, n, _ in open_ if i in more)
            full |= more
        out |= {i: 2.0 if i in full else unit * w for i, _, w in own}
    return out


@pytest.mark.parametrize("weighted", [False, True])
def test_mix_includes_by_weight_over_seeds(spark, weighted):
    texts = [(i, " ".join(["word"] * draw), ("a", "b", None)[i % 3], i // 3 % 7) for i, draw in enumerate(random.Random(9).choices([1, 3, 9, 30, 100, 400], k=900))]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string, w int").repartition(3)
    expected = slow_expectations([(i, s, len(t.split())) for i, t, s, _ in texts], (lambda i, n: i // 3 % 7) if weighted else (lambda i, n: n.bit_length()))
    total, seeds = Counter(), 6
    for k in range(seeds):
        for r in mixing.mix(docs, weight_col="w" if weighted else None, seed=f"s{k}").collect():
            assert r["copies"] in (int(expected[r["doc_id"]] + 1e-9), int(expected[r["doc_id"]] - 1e-9) + 1, int(expected[r["doc_id"]]))
            total[r["doc_id"]] += r["copies"]
    levels = defaultdict(list)
    for i, e in expected.items():
        levels[round(e, 6), texts[i][2]].append(total[i] / seeds)
    assert len(levels) > 6
    for (e, _), found in levels.items():  # the mean over documents with the same expectation
        assert abs(np.mean(found) - e) < 4 * 0.5 / math.sqrt(len(found) * seeds) + 0.01, (e, np.mean(found), len(found))


def test_mix_of_rows_that_share_an_id(spark):
    rows = [(None, f"text {i} of many words", "a") for i in range(300)] + [(7, "the same words here", "b")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, range_rows=2).collect()
    own = [r["copies"] for r in found if r["source"] == "a"]
    assert len(own) == 300 and abs(sum(r["taken"] for r in found if r["source"] == "a") - found[0]["target"]) <= 5 and len(set(own)) > 1
    mixed = [tuple(r) for r in mixing.mixed_documents(docs, range_rows=2).collect()]
    again = [tuple(r) for r in mixing.mixed_documents(docs.repartition(5)).collect()]
    assert Counter(mixed) == Counter(again) and len(mixed) == sum(r["copies"] for r in found)


@pytest.mark.parametrize("op", ["op3_source_mix", "op4_line_dedup", "op5_quality_rules"])
def test_sql_agrees(spark, op):
    same(queries.queries()[op](spark, SF1), queries.oracle_sql()[op], f"{SF1}/documents.parquet")


def test_mixed_documents_repeat_rows(spark, awkward):
    plan = mixing.mix(awkward)
    mixed = mixing.mixed_documents(awkward)
    assert mixed.columns == awkward.columns
    assert mixed.count() == plan.agg(F.sum("copies")).first()[0]


def slow_lines(rows, min_docs=5):
    key = lambda x: ascii_lower(x.strip(BLANKS))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = -(2**63) if i is None else i
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and own < max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 3, 9])
def test_line_dedup_against_brute_force(spark, awkward, batches):
    for docs in (awkward, table(spark, SF1)):
        found = line_runs.dedup_lines(docs, batches=batches).collect()
        assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in found) == slow_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
        assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in found)


def test_runs_compact_and_filter_new_batches(spark):
    runs, held, drawn = line_runs.LineRuns(spark, fan_out=2), Counter(), random.Random(3)
    for b in range(5):
        keys = [(b * 100 + i, f"key{drawn.randint(0, 60)}".encode()) for i in range(40)] + [(b * 100, b"all"), (b * 100, b"all")]
        runs.add(spark.createDataFrame(keys, "doc_id long, key binary"))
        held.update(k for _, k in set(keys))
        own = [bytes(r["key"]) for run in runs.runs() for r in spark.table(run).collect()]
        assert sorted(own) == sorted(held)  # every key lies in one run
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {bytes(r["key"]): r["last_doc"] for r in runs.frequent(5).collect()}[b"all"] == 400
    assert {bytes(r["key"]) for r in runs.frequent(5).collect()} == {k for k, n in held.items() if n >= 5}
    runs.close()


def test_batches_are_anti_joined_with_sorted_runs(spark, awkward, monkeypatch):
    calls, kinds = [], []
    unseen = line_runs.LineRuns.unseen

    def watched(self, sums):
        out = unseen(self, sums)
        calls.append((len(self.runs()), sums.count(), out.count()))
        kinds.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(line_runs.LineRuns, "unseen", watched)
    line_runs.dedup_lines(table(spark, SF1), batches=6).count()
    assert [n for n, _, _ in calls] == [1, 2, 1, 2, 3]  # each batch but the first, against all runs there are
    assert sum(before - after for _, before, after in calls) > 0
    assert all("SortMergeJoin" in p and "LeftAnti" in p and "Exchange" not in p and "Sort [" not in p for p in kinds)


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_lookups_beyond_the_broadcast_bound(spark, how):
    many = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(9000)], "row long, key long").repartition(4)
    one = spark.createDataFrame([(k, -k) for k in range(0, 9000, 2)], "key long, v long")
    few, split = (common.looked_up(many, one, "key", how, most) for most in (10_000, 10))
    assert few.columns == split.columns and Counter(map(tuple, few.collect())) == Counter(map(tuple, split.collect()))


def slow_measures(text):
    text = text or ""
    w = split_words(text)
    spans = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(spans)
    covered = {i + k for i, s in enumerate(spans) if often[s] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if split_words(x)]
    n = len(w)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures_against_brute_force(spark, awkward):
    for docs in (awkward, table(spark, SF1)):
        found = Counter(tuple(r)[:7] for r in quality_rules.measure(docs).collect())
        assert found == Counter((r["doc_id"], *slow_measures(r["text"])) for r in docs.collect())


def test_cascade_order_never_changes_the_verdict(spark, monkeypatch):
    docs = table(spark, SF10)
    expected = {r["doc_id"] for r in quality_rules.measure(docs).where("kept").collect()}
    rules = [*quality_rules.base_rules(), *quality_rules.further_rules()]
    order = quality_rules.ordered(docs, rules, 200)
    assert sorted(r.name for r in order) == sorted(r.name for r in rules)
    for seed in range(2):
        random.Random(seed).shuffle(rules)
        monkeypatch.setattr(quality_rules, "ordered", lambda *a, now=list(rules): now)
        assert {r["doc_id"] for r in quality_rules.filtered(docs).collect()} == expected
    good = table(spark, SF10, "labels").where("quality = 1").join(quality_rules_measure(spark), "doc_id")
    assert good.where("NOT kept AND NOT base_failed").count() == 0


def test_cascade_order_is_rejection_per_cost_and_stable(spark):
    docs = table(spark, SF10)
    rules = [*quality_rules.base_rules(), *quality_rules.further_rules()]
    names = [[r.name for r in quality_rules.ordered(docs, rules)] for _ in range(3)]
    assert names[0] == names[1] == names[2] and names[0][0] == "short"
    text = [r["text"] or "" for r in docs.collect()]  # fewer than the sample, so all rows are in it
    share = {"short": np.mean([len(split_words(t)) < 50 for t in text]), "repeats": np.mean([100 * slow_measures(t)[4] > 50 * slow_measures(t)[0] for t in text])}
    cost = {"short": 1, "repeats": quality_rules.WINDOWS * np.mean([len(split_words(t)) for t in text])}
    symbols = np.mean([10 * slow_measures(t)[2] > slow_measures(t)[0] for t in text]) / (quality_rules.SPLIT * np.mean([len(t) for t in text]))
    by_hand = sorted([("short", share["short"] / cost["short"]), ("repeats", share["repeats"] / cost["repeats"]), ("symbols", symbols)], key=lambda x: -x[1])
    assert [n for n in names[0] if n in dict(by_hand)] == [n for n, _ in by_hand]


def test_filter_on_the_verdict_does_not_split_words_again(spark):
    plan = quality_rules.measure(table(spark, SF1)).where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(trim(") == 1


def quality_rules_measure(spark):
    return quality_rules.measure(table(spark, SF10))


def slow_chunks(data, block):
    """The signature at a block size: byte by byte, a character for each chunk, 64 at most."""
    out, start = "", 0
    for i in range(len(data)):
        window = (bytes(7) + data)[i + 1 : i + 8]
        h = (int.from_bytes(window, "little") << 8) * 0x9E3779B97F4A7C15 % 2**64 >> 32
        last = i + 1 == len(data)
        if last or (h % block == block - 1 and len(out) < 63):
            out += piecewise_hash.ALPHABET[xxhash.xxh64_intdigest(data[start : i + 1]) % 64]
            start = i + 1
    return out


def slow_ends(data, block):
    hashes = [(int.from_bytes((bytes(7) + data)[i + 1 : i + 8], "little") << 8) * 0x9E3779B97F4A7C15 % 2**64 >> 32 for i in range(len(data))]
    return sum(h % block == block - 1 for h in hashes)


def slow_piecewise(text):
    data, block = (text or "").encode(), 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and slow_ends(data, block) < 16:
        block //= 2
    return block, slow_chunks(data, block), slow_chunks(data, 2 * block)


def slow_likeness(x, y):
    if x == y:
        return 1.0
    best = 0.0
    for i, j in ((1, 1), (2, 2), (1, 2), (2, 1)):
        a, b = x[i], y[j]
        if x[0] * i != y[0] * j or not a or not b:
            continue
        run = max(1, min(4, len(a) // 2, len(b) // 2))
        if a == b:
            best = 1.0
        elif any(a[k : k + run] in b for k in range(len(a) - run + 1)):
            row = [0] * (len(b) + 1)
            for c in a:
                new = [0]
                for k, d in enumerate(b):
                    new.append(row[k] + 1 if c == d else max(new[k], row[k + 1]))
                row = new
            best = max(best, 2 * row[-1] / (len(a) + len(b)))
    return best


def test_piecewise_hash_against_brute_force(spark, awkward):
    for docs in (table(spark, SF1), awkward.where("doc_id NOT IN (5, 40, 41)")):
        rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
        found = {r["doc_id"]: r for r in piecewise_hash.fingerprint_documents(docs).collect()}
        assert len(found) == len(rows)
        near = []
        for k, (i, text) in enumerate(rows):
            after = rows[(k + 1) % len(rows)][1]
            n = len(text)
            edited = text[: n - n // 2] + after[: n // 2]
            r = found[i]
            assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
            own, other, following = (slow_piecewise(x) for x in (text, edited, after))
            assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{own[0]}:{own[1]}:{own[2]}", f"{other[0]}:{other[1]}:{other[2]}")
            assert (r["near_edited"], r["near_next"]) == (pytest.approx(slow_likeness(own, other)), pytest.approx(slow_likeness(own, following)))
            near.append(r["near_edited"])
        assert max(near) > 0.4


def test_piecewise_hash_of_rows_that_share_an_id(spark):
    draw = random.Random(7)
    rows = [(None, f"text {draw.random()} of a row without an id") for _ in range(400)] + [(5, "a first row"), (9, "a last row")] + [(None, "the same")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt = Counter(r["bucket"] for r in piecewise_hash.with_next(docs).select("bucket").collect())
    assert len(dealt) == 4 and max(dealt.values()) < 200
    found = piecewise_hash.fingerprint_documents(docs).collect()
    assert len(found) == len(rows) and Counter(r["fingerprint"] for r in found) == Counter(piecewise_hash.fingerprint(t) for _, t in rows)
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))]
    edits = [hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][: len(t) // 2]).encode()).hexdigest() for k, t in enumerate(order)]
    assert Counter(r["edited_sha256"] for r in found) == Counter(edits)


def test_piecewise_hash_pieces(spark, monkeypatch):
    text = table(spark, SF10).orderBy(F.length("text").desc()).first()["text"]
    whole = piecewise_hash.fingerprint(text)
    monkeypatch.setattr(piecewise_hash, "_SEGMENT", 1000)
    assert piecewise_hash.fingerprint(text) == whole
    data = text.encode()[:500]
    slow = [(int.from_bytes((bytes(6) + data)[i : i + 7], "little") << 8) * 0x9E3779B97F4A7C15 % 2**64 >> 32 for i in range(len(data))]
    assert piecewise_hash.window_hashes(data).tolist() == slow

    def slow_common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *row]
            last = row[1:]
            new = [0]
            for j, y in enumerate(b):
                new.append(last[j] + 1 if x == y else max(last[j + 1], new[j]))
            row = new
        return row[-1]

    draw = random.Random(1)
    for _ in range(50):
        a, b = ("".join(draw.choices("abcd", k=draw.randint(1, 64))) for _ in range(2))
        assert piecewise_hash._common(a, b) == slow_common(a, b)
    start, end = text[:8000], text[8000:16000]
    assert piecewise_hash.likeness(piecewise_hash.fingerprint(start), piecewise_hash.fingerprint(start[:4000] + end[:4000])) > 0.3
    assert piecewise_hash.likeness(piecewise_hash.fingerprint(start), piecewise_hash.fingerprint(start)) == 1


@pytest.mark.parametrize(("op", "label"), [("op7_toxicity", "toxic"), ("op8_quality", "quality")])
def test_classifiers_on_held_out_rows(spark, op, label):
    found = queries.queries()[op](spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").collect()
    yes, no = ([r["score"] for r in found if r[label] == v] for v in (1, 0))
    assert np.mean([a > b for a in yes for b in no]) > 0.93
    assert np.mean([r["predicted"] == r[label] for r in found]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_factorization_machine_pairs():
    draw = np.random.default_rng(0)
    x = draw.integers(0, 2, (2000, 6)).astype(bool)
    y = (x[:, 0] & x[:, 1]).astype(float)  # only the pair matters
    owner, term = np.nonzero(x)
    m = toxicity_fm.train(owner, term, y, np.arange(6, dtype=np.int32))
    out = m.logits(owner, term, len(y))
    assert ((out > 0) == (y > 0)).mean() > 0.99
    k = 5
    on = np.flatnonzero(x[k])
    slow = m.bias + m.weights[on].sum() + sum(m.vectors[a] @ m.vectors[b] for i, a in enumerate(on) for b in on[i + 1 :])
    assert out[k] == pytest.approx(slow)


def test_trees_flattened_equal_walked():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = quality_trees.train(x, y)
    assert ((t.scores(x) > 0.5) == (y > 0)).mean() > 0.97
    total = t.bias
    for f, a, leaf in zip(t.feature, t.above, t.leaf, strict=True):
        at = 0
        for _ in range(quality_trees.DEPTH):
            at = 2 * at + 1 + int(x[7, f[at]] > a[at])
        total += leaf[at - len(f)]
    assert t.scores(x[7:8])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def slow_words(text):
    out, now = [], ""
    for c in ascii_lower(text or ""):
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) > 127:
            now += c
        else:
            out += [now] if now else []
            now = ""
    return out + ([now] if now else [])


def test_license_base_places_against_brute_force(spark, awkward):
    phrases = {k: v.split() for k, v in {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}.items()}
    for docs in (table(spark, SF10), awkward):
        found = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in license_search.scan_licenses(docs).collect())
        expected = Counter()
        for r in docs.collect():
            w = slow_words(r["text"])
            at = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]
            starts = [i for i, _ in at]
            expected[(r["doc_id"], len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in at})))] += 1
        assert found == expected


def test_license_edits_and_spans():
    s = license_search.Search()
    found = s.scan("Intro words.\nReleesed under tha MIT-License, enjoy")
    assert found["labels"] == "mit" and found["n_base"] == 0 and 0.8 < found["score"] < 1
    (span,) = found["spans"]
    assert (span["first"], span["last"], span["edits"]) == (2, 6, 2)
    assert s.scan("Releesed under teh MIT-License")["labels"] == ""  # three edits are one too many
    exact = s.scan("This work is licensed under the GNU General Public License, version 3.")
    assert exact["labels"] == "gpl-3" and exact["score"] == 1.0 and exact["spans"][0]["edits"] == 0
    assert s.scan("Licensed under CC BY-NC 4.0.")["base_labels"] == "cc-by-nc"
    assert s.scan("nothing to see under the sun, mit ohne license")["labels"] == ""


@pytest.mark.parametrize(
    ("text", "labels"),
    [("licensed under cc by nd 4 0", "cc-by-nd"), ("licensed under cc by nc nd 4 0", "cc-by-nc,cc-by-nc-nd"), ("licensed under the gnu general public license version 4", "gpl"),
     ("licensed under the gnu lesser general public license version 3", "lgpl-3"), ("licensed under the gnu affero general public license v3", "agpl-3"), ("licensed under cc by 4 0", "cc-by"),
     ("xlicensed under cc by 4 0", "cc-by"), ("élicensed under cc by 4 0ß", ""), ("licensed under cc by 4 0ß", ""), ("éélicensed under cc by 4 0", ""),
     ("licensed under cc by 4 1", ""), ("under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 license", "cc-by-nc-sa"), ("licensed under the apache license version 1 0", "")],
)
def test_license_labels_of_relatives(text, labels):
    assert license_search.Search().scan(f"some words {text} and more")["labels"] == labels


def slow_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def slow_verified(body):
    """(label, start of words, end of words, edits) of all runs of words near enough to a notice, its tail after them."""
    gaps = [i for i, c in enumerate(body) if c == 32]
    for label, words, tail in license_search.NOTICES:
        most, words, tail = min(license_search.MOST_EDITS, len(words) // license_search.CHARS_PER_EDIT), words.encode(), f" {tail} ".encode() if tail else b" "
        for a in gaps:
            for z in gaps:
                if abs(z - a - 1 - len(words)) <= most and z > a and body[z : z + len(tail)] == tail and (n := slow_edits(body[a + 1 : z], words)) <= most:
                    yield label, a + 1, z, n


def test_license_labels_against_brute_force():
    draw, s = random.Random(8), license_search.Search()
    for _ in range(60):
        parts = []
        for _, words, tail in draw.choices(license_search.NOTICES, k=2):
            hit = list(f"{words} {tail}".strip())
            for _ in range(draw.randint(0, 5)):
                i = draw.randrange(len(hit))
                hit[i : i + draw.randint(0, 1)] = draw.choice(["", "q", " ", "e"])
            parts += draw.choices(["the", "of", "work", "is", "freely", "licensed"], k=draw.randint(0, 3)) + ["".join(hit)]
        body, _ = license_search.normal(" ".join(parts))
        slow = list(slow_verified(body))
        found = s.verified(body)
        tails = {(label, words): tail for label, words, tail in license_search.NOTICES}
        assert tails and {x.label for x in found} == {x[0] for x in slow}
        for x in found:  # each is one of the slow ones, with the fewest edits of those that it overlaps
            same = [y for y in slow if y[0] == x.label and y[1] < x.end and y[2] > x.start]
            assert min(y[3] for y in same) <= x.edits and any((y[1], y[3]) == (x.start, x.edits) for y in same)
        best = s.spans(body)
        assert all(a.end <= b.start for a, b in zip(best, best[1:], strict=False))
        for x in found:
            assert any(x.start < y.end and y.start < x.end and y.edits / y.notice_chars <= x.edits / x.notice_chars for y in best)


def test_license_scan_is_linear_in_notices():
    import time

    s, took = license_search.Search(), []
    for n in (1000, 4000):
        text = "released under the mit licence and some more words here " * n
        began = time.perf_counter()
        assert len(s.scan(text)["spans"]) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0]


def test_bpe_equals_tiktoken(spark, awkward):
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=spm_bpe.read_ranks(RANKS), special_tokens={})
    for docs in (table(spark, SF1), awkward.where(F.length("text") < 1000)):
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        for r in spm_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect():
            if r["doc_id"] in (5, None):  # ids that several rows share
                continue
            text = texts[r["doc_id"]]
            ids = reference.encode_ordinary(text)
            assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_odd_texts_and_small_memory(monkeypatch):
    ranks = spm_bpe.read_ranks(RANKS)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(spm_bpe, "REMEMBERED", 5)
    monkeypatch.setattr(spm_bpe, "AT_ONCE", 7)
    codec = spm_bpe.Codec(spm_bpe.serialise(ranks), public_tokenizers.PATTERN)
    draw = random.Random(2)
    texts = ["<|endoftext|>", "▁ ▁x", "\x00\x01", "  lead and trail  \n\n\t", "a" * 500, "\U0001f468‍\U0001f469 ­ ", "don't I'LL 12345 你好"]
    texts += ["".join(chr(draw.choice([*range(32, 127), *range(160, 400), 0x4E2D, 0x1F600])) for _ in range(60)) for _ in range(200)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()
    assert list(codec.encode_all(texts)) == [reference.encode_ordinary(t) for t in texts]


def slow_similar(rows):
    """{doc_id: smallest doc_id connected} over pairs of texts whose sets of five-word shingles are 0.8 alike."""
    sets, holders = {}, defaultdict(list)
    for i, text in rows:
        w = split_words(ascii_lower(text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        for x in sets[i]:
            holders[x].append(i)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    empty = [i for i, own in sets.items() if not own]
    for i in empty[1:]:
        up[root(i)] = root(empty[0])
    for i, own in sets.items():
        for j, both in Counter(k for x in own for k in holders[x] if k > i).items():
            if 5 * both >= 4 * (len(own) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i in sets:
        least[root(i)] = min(i, least.get(root(i), i))
    return {i: least[root(i)] for i in sets}


@pytest.mark.parametrize("sf", [SF1, SF10])
def test_near_texts_against_brute_force(spark, sf):
    docs = table(spark, sf)
    expected = slow_similar([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in near_texts.first_of_each(docs).select("doc_id").collect()) == sorted(set(expected.values()))


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        k = draw.randrange(len(words))
        words[k : k + draw.randint(0, 1)] = [draw.choice(["qq", "zz", "xx"])]
    return words


def test_near_texts_in_blocks_and_shuffled(spark, monkeypatch):
    draw = random.Random(12)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = draw.choices(vocabulary, k=60)
    texts = []
    for _ in range(25):  # groups of copies with a few edits, and others that share a passage only
        base = draw.choices(vocabulary, k=draw.randint(60, 200))
        texts += [" ".join(edited(draw, base, draw.randint(0, 7))) for _ in range(draw.randint(1, 12))]
        texts += [" ".join(passage + draw.choices(vocabulary, k=draw.choice([5, 40, 200])))]
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    expected = sorted(set(slow_similar(rows).values()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in near_texts.first_of_each(docs).collect()) == expected
    assert sorted(r["doc_id"] for r in near_texts.first_of_each(docs, unit=300).collect()) == expected
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5)
    assert sorted(r["doc_id"] for r in near_texts.first_of_each(docs, unit=2000).collect()) == expected


def test_near_texts_of_awkward_rows(spark, awkward):
    kept = near_texts.first_of_each(awkward)
    assert kept.columns == awkward.columns
    found = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert set(found.values()) == {1}
    # Wordless rows are one group; repeated rows and null ids stay once; the rest stay.
    assert {i for i, _ in found} == {1, 4, 5, None, 6, 7, 20, 21, 22, 23, 24, 25, 40, 41, 42}
    assert [t for i, t in found if i is None] == ["no id here"] and len([1 for i, _ in found if i == 5]) == 2
    clash = awkward.withColumn("r", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("TEXT_HASH", F.lit(2))
    assert near_texts.first_of_each(clash).columns == clash.columns and near_texts.first_of_each(clash).count() == kept.count()
    assert near_texts.first_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bands_reach_the_similarity():
    missed = (1 - near_texts.SIMILARITY**near_texts.ROWS) ** near_texts.BANDS
    assert missed < 4e-6
    draw, hits = np.random.default_rng(4), 0
    for _ in range(300):
        both, a, b = (draw.integers(0, 2**63, k, dtype=np.uint64) for k in (160, 20, 20))
        one, two = (near_texts.band_keys(np.unique(np.concatenate((both, x)))) for x in (a, b))
        hits += len(set(one.tolist()) & set(two.tolist()))
    assert hits / 300 / near_texts.BANDS == pytest.approx(0.8**near_texts.ROWS, abs=0.03)
