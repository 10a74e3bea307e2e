"""The stages of the pipeline against brute force."""

from __future__ import annotations

import random
import re

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from provenant.llm import neardup  # noqa: E402


def slow_shingles(t: str | None) -> set[tuple[str, ...]]:
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def slow_kept(rows: list[tuple]) -> set:
    """Ids that stay: the least of each component of pairs with Jaccard >= 0.8."""
    sets = [slow_shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups: dict = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return {min(g, key=lambda i: (i is None, i or 0)) for g in groups.values()}


def near_copies(seed: int) -> list[tuple]:
    """Texts and copies of them with some words changed, of similarities on both sides of 0.8; a crowd of texts with one long passage; short and empty texts."""
    r = random.Random(seed)
    words = lambda n: [f"w{r.randrange(50_000)}" for _ in range(n)]
    texts: list = [None, "", " \n", "one", "One", "one two", "a b c d e", "A  b\tc d E", "a b c d f", "ü b c d e", "Ü b c d e"]
    for _ in range(60):
        base = words(r.choice([30, 100, 100, 300]))
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            texts.append(" ".join(w if r.random() > share else "changed" for w in base))
    passage = words(80)
    for _ in range(70):
        own = words(r.choice([18, 19, 20, 21, 24]))
        texts += [" ".join(passage + own), " ".join(passage + own[:-1])]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows + [rows[5], (None, "a b c d e", "en", "src", 9), (None, "alone here", "en", "src", 10)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize(("seed", "members"), [(1, 256), (2, 256), (3, 16)])
def test_near_dedup_matches_brute_force(spark, seed, members, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS", members)  # small blocks: families meet in many pairs of them
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = corpus_pipeline.near_dedup(spark, df, "").collect()
    want = slow_kept(rows)
    assert len(want) < len(rows) - 100
    assert len(got) == len(want) and {r.doc_id for r in got} == want
    assert set(map(tuple, got)) <= set(rows)
    assert corpus_pipeline.near_dedup(spark, df.where("false"), "").count() == 0


def test_true_copies_meet_once_and_chains_by_keys(spark, monkeypatch):
    """A crowd of true copies is joined by its blocks and pivots; texts that are only joined through others meet by their keys."""
    monkeypatch.setattr(neardup, "MEMBERS", 16)
    r = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    crowd = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(200)]  # similarity 0.9 and more
    long = [f"c{i}" for i in range(900)]
    chain = [" ".join(long[i : i + 60]) for i in range(0, 840, 8)]  # neighbours 0.76, so none is alike
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(crowd + chain)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    given = df.selectExpr("xxhash64(text) AS node", "text")
    members = neardup.groups(neardup.keyed(given)).cache()
    sizes = {g["group"]: g for g in members.groupBy("group").agg({"node": "count", "blocks": "max"}).collect()}
    assert max(g["count(node)"] for g in sizes.values()) == 200  # the crowd is one group
    chained = members.join(given.where("text LIKE 'c%'"), "node")
    assert chained.select("group").distinct().count() > 5 and chained.agg({"blocks": "max"}).first()[0] <= 2  # the chain is many
    joined = neardup.components(neardup.compared(given.join(neardup.within(members), "node").withColumnRenamed("group", "root")))
    left = neardup.across(members, joined)
    assert left.join(given.where("text LIKE 'w%' OR text LIKE 'x%'"), "node").count() == 0  # nothing is left to meet
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, df, "").collect()} == slow_kept(rows)


def test_keys_are_of_the_shingles_alone():
    a, b = neardup.keys([b"x y z u v w", b"q"]), neardup.keys([b"q", b"", b"X\ty z u  v w\n", b"x y z u v w x y z u v w"])
    assert a[0].tolist() == [2, 1] and b[0].tolist() == [1, 1, 2, 6]
    assert a[1][0].tolist() == b[1][2].tolist() and a[1][1].tolist() == b[1][0].tolist()


def test_forest_joins_what_brute_force_joins():
    texts = [r[1].encode() for r in near_copies(5) if r[1]]
    whole = slow_kept([(i, t.decode()) for i, t in enumerate(texts)])

    def roots(pairs):
        root = list(range(len(texts)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return {find(i) for i in range(len(texts))}

    links = neardup.forest(texts)
    assert roots(links) == whole and len(links) < len(texts)
    side = [i % 2 for i in range(len(texts))]
    across, inside = neardup.forest(texts, side), []
    for k in (0, 1):
        of = [i for i in range(len(texts)) if i % 2 == k]
        inside += [(of[a], of[b]) for a, b in neardup.forest([texts[i] for i in of])]
    assert all(side[a] != side[b] for a, b in across) and roots(across + inside) == whole
    assert neardup.forest([]) == [] and neardup.forest([b""] * 9) and neardup.forest([b"a", b"b"]) == []


def test_the_whole_against_brute_force(spark, tmp_path):
    """run(): rejected, alike, contaminated documents go and secrets are replaced; the rest comes back as it was, with its ids."""
    import base64

    import public_tokenizers
    import tiktoken

    from provenant.llm import quality, secrets

    r = random.Random(21)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    good = lambda n=80: " ".join(word() for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(400):
        text = good() if i % 2 else " ".join(w.upper() + "!!" for w in good().split())
        rows.append((i, text, "en", "src", len(text)))
        labels.append((i, i % 2, 0))
    item = good(30)[:-1]
    add = lambda text: rows.append((len(rows), text, "en", "src", len(text or "")))
    for i in range(1, 60, 2):
        w = rows[i][1].split()
        add(rows[i][1])  # a copy
        add(" ".join(w[:40] + ["changed"] + w[41:]))  # a near copy
    for _ in range(12):
        w = good().split()
        add(" ".join(w[:20] + item.split()[5:20] + w[20:]))
        add(" ".join([*w[:20], "password=hunter2hunter2", *w[20:]]))
    add(None), add("")
    rows.append(rows[401])
    rows.append((None, good(), "en", "src", 3))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    scored = quality.classify(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    passed = {x.doc_id for x in scored.collect() if x.predicted}
    left = [x for x in rows if x[0] in passed]
    alike = slow_kept(left)
    left = {x[0]: x for x in left if x[0] in alike}
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    windows = {tuple(words(item)[k : k + 10]) for k in range(21)}
    left = {i: x for i, x in left.items() if not any(tuple(words(x[1])[k : k + 10]) in windows for k in range(len(words(x[1])) - 9))}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in got} == set(left) and len(got) == len(left)
    assert len(passed) > 200 and len(left) < len(passed) - 60 and not any(i < 400 and i % 2 == 0 for i in left if i is not None)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    tk = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    secret = re.compile(secrets.ASSIGN)
    seen = 0
    for x in got:
        want = secret.sub("[SECRET]", left[x.doc_id][1] or "")
        seen += "[SECRET]" in want
        assert x.text == want and (x.lang, x.source) == ("en", "src") and x.n_chars == (len(want) if "[SECRET]" in want else left[x.doc_id][4])
        assert [int.from_bytes(bytes(x.ids)[k : k + 4], "little") for k in range(0, len(x.ids), 4)] == tk.encode_ordinary(want) and x.n_tokens == len(x.ids) // 4
    assert seen >= 8


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_of_awkward_tables(spark, tmp_path, k):
    """Each stage of nulls, empty and long texts, repeated rows, clashing columns, and no rows at all."""
    name, stage = corpus_pipeline.STAGES[k]
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a window of ten words that is nowhere else at all"), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "plain words of a text that is like no other in this table", None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, "long " * 60_000, "en", "s", 300_000), (4, "long " * 60_000, "en", "s", 300_000), (None, "text without an id", "en", "s", 18), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("text hash", "root", "node", "score", "_text", "spans", "hits", "x", "key", "row", "scanned", "own 0"):
        df = df.withColumn(c, __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    got = stage(spark, df.repartition(3), str(tmp_path))
    assert set(df.columns) <= set(got.columns) and (k == len(corpus_pipeline.STAGES) - 1 or got.columns == df.columns)
    kept = got.collect()
    ids = sorted((x.doc_id for x in kept), key=str)
    if name != "quality_classifier":
        assert {1, 4} <= set(ids) and len(kept) == {"near_dedup": 4}.get(name, len(rows)), (name, ids)
        assert all((x.text or "") == (y or "") for x in kept if x.doc_id is not None for i, y, *_ in rows if i == x.doc_id)
    assert stage(spark, df.where("false"), str(tmp_path)).count() == 0
