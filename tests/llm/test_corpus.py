"""Sharding, language ID, decontamination, near dedup and the pipeline."""

from __future__ import annotations

import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphlake.llm import decontaminate, language_id, near_dedup, queries, sharding, words
from graphlake.llm.common import table

SF = "/root/testdata/sf0.01"


# -- sharding


def check_shards(rows, texts: list[str | None]):
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and (not rows or max(sizes.values()) - min(sizes[s] for s in range(24)) <= 1)
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)


def test_shards(spark, odd, none):
    check_shards(sharding.shard(spark, odd).collect(), [r.text for r in odd.collect()])
    assert sharding.shard(spark, none).count() == 0


def test_linked_documents_meet(spark):
    docs = table(spark, SF, "documents")
    rows = sharding.shard(spark, docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    check_shards(rows, [r.text for r in rows])
    groups = defaultdict(list)
    for r in rows:
        groups[r.text].append(r.shard)
    linked = [g for g in groups.values() if len(g) > 1]
    assert sum(len(set(g)) > 1 for g in linked) <= 0.05 * len(linked)


def test_a_hot_group_is_split_evenly(spark):
    texts = ["same"] * 500 + [f"t{i % 100}" for i in range(400)] + [f"own {i}" for i in range(37)]
    rows = sharding.shard(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    check_shards(rows, texts)


def plain_propagation(groups: list[str], shards: int, rounds: int, seed: int) -> int:
    """Links cut by label propagation row by row under the same quotas, from a random start."""
    r = random.Random(seed)
    n = len(groups)
    cap = [n // shards + (s < n % shards) for s in range(shards)]
    at = [s for s in range(shards) for _ in range(cap[s])]
    r.shuffle(at)
    load = Counter(at)
    members = defaultdict(list)
    for i, g in enumerate(groups):
        members[g].append(i)
    for _ in range(rounds):
        for i in r.sample(range(n), n):
            near = Counter(at[k] for k in members[groups[i]] if k != i)
            for s, many in near.most_common():
                if many <= near[at[i]]:
                    break
                if load[s] < cap[s]:
                    load[s], load[at[i]], at[i] = load[s] + 1, load[at[i]] - 1, s
                    break
                swap = next((k for k in range(n) if at[k] == s and len(members[groups[k]]) == 1), None)
                if swap is not None:
                    at[swap], at[i] = at[i], s
                    break
    return sum(a != b for m in members.values() for x, a in enumerate(at[i] for i in m) for b in [at[i] for i in m][x + 1 :])


def test_cuts_no_more_links_than_plain_propagation(spark):
    groups = [f"g{i % 60}" for i in range(300)] + [f"h{i % 9}" for i in range(90)] + [f"own {i}" for i in range(330)]
    docs = spark.createDataFrame(list(enumerate(groups)), "doc_id bigint, text string")
    rows = sharding.shard(spark, docs).join(docs, "doc_id")
    check_shards(rows.collect(), groups)
    links = sum(n * (n - 1) // 2 for n in Counter(groups).values())
    got = sharding.cut_links(rows).head()
    assert got.links == links and got.cut <= min(plain_propagation(groups, 24, 8, s) for s in range(3))
    assert tuple(sharding.cut_links(rows.limit(0)).head()) == (0, 0)


def test_only_groups_above_a_shard_are_split(spark):
    texts = ["just fits"] * 40 + [f"own {i}" for i in range(24 * 40 - 40 - 100)] + ["too large"] * 100
    rows = sharding.shard(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    check_shards(rows, texts)
    shards = defaultdict(set)
    for r in rows:
        shards[texts[r.doc_id]].add(r.shard)
    assert len(shards["just fits"]) == 1 and len(shards["too large"]) <= 5


# -- language


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    rows = language_id.identify(spark, language_id.held_out(docs)).filter("held_out").collect()
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_learns_from_the_others_alone(spark):
    docs = language_id.held_out(table(spark, SF, "documents"))
    a = queries.op6_language_id(spark, SF).orderBy("doc_id").collect()
    lied = docs.withColumn("lang", F.when(F.col("held_out"), F.lit("xx")).otherwise(F.col("lang"))).withColumn("text", F.col("text"))
    b = language_id.identify(spark, language_id.held_out(docs.select("doc_id", "text")), language_id.train(spark, lied)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.lang_pred, r.score) for r in a] == [(r.doc_id, r.lang_pred, r.score) for r in b]


def test_language_rejects_what_is_unlike_all(spark):
    model = language_id.train(spark, table(spark, SF, "documents"))
    texts = ["жълтата дюля беше щастлива че пухът който цъфна замръзна като гьон " * 4, "123 !!", "", "qzx jvk wqx zzk qqj xkz vvq jxq " * 6]
    lang, score, rejected = model.predict(texts)
    assert lang[1:3] == ["und", "und"] and score[1] == score[2] == 0 and rejected.all()


def test_language_odd_rows(spark, odd, none):
    rows = language_id.identify(spark, odd).collect()
    assert len(rows) == odd.count() and all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)
    assert language_id.identify(spark, none).count() == 0
    lone = language_id.identify(spark, odd, language_id.train(spark, none)).collect()
    assert {r.lang_pred for r in lone} == {"und"}


def test_letters_and_the_sample(spark):
    marks = "\u0301\u0302 123"
    assert language_id.counts([marks, "a\u0301"])[1].tolist() == [0, 1]
    rows = [(i, None if i % 2 else f"word{i} of text", f"l{i % 30:02}", "s") for i in range(3000)] + [(7_000_000, "hot text", "l00", "s")] * 2000 + [(-i, marks, "zz", "s") for i in range(1, 99)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = language_id.sample_of(docs, sample=40, texts=300).collect()
    each = Counter(r.lang for r in got)
    assert set(each) == {f"l{i:02}" for i in range(0, 30, 2)} and set(each.values()) == {20} and all(r.doc_id % 2 == 0 for r in got)
    with pytest.raises(ValueError):
        language_id.sample_of(docs, texts=10)


def test_predictions_equal_plain_cosines(spark):
    """TF-IDF over hashed n-grams and cosines with the centroids, worked out text by text with dictionaries."""
    docs = table(spark, SF, "documents")
    model = language_id.train(spark, docs)
    rows = language_id.identify(spark, docs.limit(60), model).collect()

    def plain(text: str) -> tuple[str, float]:
        kept = []
        for c in text.lower():
            letter = unicodedata.category(c)[0] in "LM"
            if letter or (kept and kept[-1] != 32):
                kept.append(ord(c) if letter else 32)
        kept.append(32)
        found: Counter = Counter()
        for n in range(1, 4):
            for i in range(len(kept) - n + 1):
                h = 0
                for k in range(n):
                    h = (h * 0x100000001B3 + kept[i + k] + k + 1) & (1 << 64) - 1
                found[int(words.mix(np.array([h], np.uint64))[0]) % language_id.FEATURES] += 1
        vector = {f: math.log1p(n) * float(model.idf[f]) for f, n in found.items()}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        scores = [sum(x * float(c[f]) for f, x in vector.items()) / norm for c in model.centroids]
        best = max(range(len(scores)), key=lambda i: scores[i])
        return model.languages[model.owner[best]], scores[best]

    for r in rows:
        if r.lang_pred != "und" and len(r.text) < 4000:
            lang, score = plain(r.text)
            assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4)


# -- decontamination


def grams(text: str) -> Counter:
    w, first = words.word_hashes([text])
    return Counter(words.shingles(w, first, min(5, len(w)))[0].tolist()) if len(w) else Counter()


def brute_hits(docs: list[tuple[int, str]], items: list[tuple[int, str]]) -> dict[tuple[int, int], float]:
    """The best similarity of any window of an item's size, for those of 0.8 or more."""
    out = {}
    for item, said in items:
        own, n = grams(said), len(words.word_hashes([said])[0])
        if not n:
            continue
        for doc, text in docs:
            w = words.word_hashes([text])[0]
            best = 0.0
            for i in range(len(w) - n + 1):
                part = Counter(words.shingles(w[i : i + n], np.array([0, n]), min(5, n))[0].tolist())
                best = max(best, sum((part & own).values()) / sum((part | own).values()))
            if best >= 0.8:
                out[doc, item] = best
    return out


def test_decontamination_equals_brute_force(spark):
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: [random.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([60, 80, 59, 30, 16, 5, 3, 1])] + [(20, ""), (21, "...")]
    docs = []
    for i in range(60):
        body, (_, said) = say(120), items[i % 6]
        part = said.split()
        for _ in range(i % 4):
            at = random.randrange(len(part))
            part = part[:at] + random.choice([[], say(1), [part[at].upper() + ","]]) + part[at + 1 :] if random.random() < 0.7 else part[: at + 1] + say(1) + part[at + 1 :]
        at = random.randrange(100)
        docs.append((i, " ".join(body[:at] + part + body[at:])))
    want = brute_hits(docs, items)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(spark, d, b).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)
    assert decontaminate.keep_clean(spark, d, b).count() == 60 - len({k[0] for k in want})


def test_documents_of_fewer_words_than_an_item(spark):
    """Each such document is one window: an item cut off at its ends, or without some of its words."""
    random.seed(12)
    items = [(i, " ".join(random.choice([f"w{k}" for k in range(40)]) for _ in range(n))) for i, n in enumerate([50, 80, 30, 12, 9, 6, 5, 2])]
    docs, bodies = [], [said.split() for _, said in items]
    for body in bodies:
        for cut in range(len(body)):
            docs += [(len(docs), " ".join(body[: len(body) - cut])), (len(docs) + 1, " ".join(body[cut:]))]
        for lost in range(1, 4):
            keep = sorted(random.sample(range(len(body)), max(len(body) - lost, 0)))
            docs.append((len(docs), " ".join(body[k] for k in keep)))
    want = {}
    for item, said in items:
        size, width = len(said.split()), min(5, len(said.split()))
        for doc, text in docs:
            w = words.word_hashes([text])[0]
            for i in range(max(len(w) - size, 0) + 1 if len(w) >= width else 0):
                n = min(size, len(w))
                part, own = Counter(words.shingles(w[i : i + n], np.array([0, n]), width)[0].tolist()), grams(said)
                similarity = sum((part & own).values()) / sum((part | own).values())
                if similarity >= 0.8 and similarity > want.get((doc, item), (0,))[0]:
                    want[doc, item] = similarity, i, n
    assert sum(n < len(items[item][1].split()) for (_, item), (_, _, n) in want.items()) > 50
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in decontaminate.contaminated(spark, d, b).collect()}
    assert {k: (round(v[0], 9), *v[1:]) for k, v in got.items()} == {k: (round(v[0], 9), *v[1:]) for k, v in want.items()}
    dirty = {doc for doc, _ in want}
    assert {r.doc_id for r in decontaminate.keep_clean(spark, d, b).collect()} == {doc for doc, _ in docs} - dirty


def index_of(prints) -> decontaminate.Index:
    index = decontaminate.Index([])
    index.prints, index.sizes = prints, np.full(len(prints), 60)
    return index


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 256, (300, 32), dtype=np.uint8)
    index, asked = index_of(prints), []
    for p in prints:
        bits = np.unpackbits(p)
        bits[rng.choice(256, decontaminate.RADIUS, replace=False)] ^= 1
        asked.append(np.packbits(bits))
    for low, high in [(0, 300), (70, 130), (299, 300)]:
        window, item = index.candidates(np.stack(asked), low, high)
        assert set(range(low, high)) <= set(window[window == item].tolist()) and ((item >= low) & (item < high)).all()


def test_blocks_pass_few_others():
    rng = np.random.default_rng(6)
    index = index_of(rng.integers(0, 256, (2000, 32), dtype=np.uint8))
    window, _ = index.candidates(rng.integers(0, 256, (500, 32), dtype=np.uint8), 0, 2000)
    assert len(window) <= 0.05 * 500 * 2000


def test_similar_sets_are_within_the_radius():
    """At similarity 0.8, also where shingles repeat, which a fingerprint of plain counts would miss."""
    rng = np.random.default_rng(7)
    for n in (9, 18, 56, 200):
        for _ in range(60):
            same, lost = -(-8 * n // 9), n - -(-8 * n // 9)
            shared = rng.integers(0, 2**63, same).astype(np.uint64)
            a, b = (np.concatenate((shared, np.repeat(rng.integers(0, 2**63, 1).astype(np.uint64), lost))) for _ in range(2))
            distance = int(np.bitwise_count(decontaminate.fingerprint(a) ^ decontaminate.fingerprint(b)).sum())
            assert distance <= decontaminate.RADIUS


def test_repeated_shingles_and_many_items_of_one_length(spark):
    random.seed(13)
    say = lambda n: [f"w{random.randrange(5000)}" for _ in range(n)]
    line = say(7)
    items = [line * 4 + say(42), say(70), ["x"] * 70, say(70), ["x"] * 20 + say(50)]
    docs = []
    for k, body in enumerate(items * 4):
        own = list(body)
        own[3 * k % 70] = "changed"
        docs.append((k, " ".join(say(30) + own + ["x"] * 9 + say(30))))
    named = [(i, " ".join(x)) for i, x in enumerate(items)]
    want = brute_hits(docs, named)
    found = decontaminate.Index(named).search([t for _, t in docs])
    assert {(h.text, h.item): round(h.similarity, 9) for h in found} == {k: round(v, 9) for k, v in want.items()} and len(want) > 15
    many = decontaminate.Index(named + [(100 + i, " ".join(say(70))) for i in range(3000)])
    compared = []
    known = many.candidates
    many.candidates = lambda prints, low, high: compared.append(len(prints)) or known(prints, low, high)
    again = many.search([t for _, t in docs] + [" ".join(say(3000))])
    assert {(h.text, many.names[h.item]) for h in again} == set(want) and sum(compared) < 60 * len(want)


def test_decontamination_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, "")], "item_id bigint, text string")
    rows = decontaminate.contaminated(spark, odd, items).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "2", "None"]
    assert decontaminate.contaminated(spark, none, items).count() == 0
    assert decontaminate.contaminated(spark, odd, items.limit(0)).count() == 0
    assert decontaminate.keep_clean(spark, odd, items).count() == odd.count() - 4


def test_parts_change_nothing(spark, monkeypatch):
    whole = sorted(map(tuple, queries.op7_decontaminate(spark, SF).collect()))
    monkeypatch.setattr(decontaminate, "PART_ITEMS", 7)
    assert sorted(map(tuple, queries.op7_decontaminate(spark, SF).collect())) == whole


# -- near duplicates


def brute_classes(texts: dict[int, str]) -> dict[int, int]:
    own = {i: grams(t) for i, t in texts.items()}
    top = {i: i for i in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    where = defaultdict(set)
    for i, g in own.items():
        for x in g:
            where[x].add(i)
    seen = set()
    for group in where.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    if sum((own[a] & own[b]).values()) / sum((own[a] | own[b]).values()) >= 0.8:
                        x, y = sorted((find(a), find(b)))
                        top[y] = x
    return {i: find(i) for i in texts}


def test_near_dedup_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = near_dedup.classes(spark, docs).collect()
    want = brute_classes({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.class_id for r in rows} == want


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 8])
def test_a_large_loose_group(spark, monkeypatch, block):
    """Copies with edits, of which many pairs are not similar, so classes meet through others."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    random.seed(2)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for i in range(150):
        own = list(base)
        for _ in range(random.randint(0, 6)):
            own[random.randrange(len(own))] = f"x{random.random()}"
        texts[i] = " ".join(own)
    rows = near_dedup.classes(spark, spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(texts)


def test_a_common_passage_makes_no_pairs(spark, tmp_path):
    """Texts that share a passage, but no more than half of their words, share buckets and no rare element."""
    random.seed(8)
    passage = [f"p{i}" for i in range(80)]
    sets = {i: grams(" ".join(passage + [f"o{random.random()}" for _ in range(60)])) for i in range(60)}
    sets |= {100 + i: grams(" ".join([f"o{i}x{k}" for k in range(100)] + [f"q{j}"])) for i in range(5) for j in [i]}
    sets |= {200 + i: grams(" ".join([f"o{i}x{k}" for k in range(100)] + [f"z{j}"])) for i in range(5) for j in [i]}
    signed = lambda g: [x - (1 << 64) if x >> 63 else x for x in g]
    rows = [(i, i, signed(g)) for i, g in sets.items()]
    got = near_dedup.rare(spark.createDataFrame(rows, "rep bigint, class bigint, grams array<bigint>"), near_dedup.Scratch(spark, "test")).collect()
    keys = defaultdict(set)
    for r in got:
        keys[r.key].add(r.rep)
    met = {(a, b) for reps in keys.values() for a in reps for b in reps if a < b}
    assert met == {(100 + i, 200 + i) for i in range(5)}


def test_recall_falls_with_edits(spark):
    """A changed word takes five shingles along: copies are caught up to some 2 % of changed words, as 0.8 demands."""
    random.seed(9)
    texts, share = {}, {}
    for i in range(240):
        base = [f"v{random.randrange(10**6)}" for _ in range(200)]
        own = list(base)
        edits = i % 8
        for k in random.sample(range(10, 190), edits):
            own[k] = f"changed{random.random()}"
        texts[2 * i], texts[2 * i + 1], share[i] = " ".join(base), " ".join(own), edits
    rows = near_dedup.classes(spark, spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    found = {r.doc_id: r.class_id for r in rows}
    assert found == brute_classes(texts)
    caught = lambda n: np.mean([found[2 * i + 1] == 2 * i for i in share if share[i] == n])
    assert all(caught(n) == 1 for n in range(5)) and caught(7) < 0.5


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    a = np.repeat(rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(1, 4, 300))
    b = np.concatenate((a[: len(a) * 3 // 4], rng.integers(0, 2**63, 60).astype(np.uint64)))
    both = near_dedup.signatures(np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)]), 2, 4096)
    assert (both[0] == both[1]).mean() == pytest.approx(near_dedup.similarity(np.sort(a), np.sort(b)), abs=0.03)


def test_signatures_do_not_depend_on_the_block():
    texts = ["one two three four five six seven", "a b", "word " * 50, "x"]
    g, o, _ = near_dedup._profile(texts)
    whole = near_dedup.signatures(g, o, len(texts))
    for i, t in enumerate(texts):
        g, o, _ = near_dedup._profile([t])
        assert (near_dedup.signatures(g, o, 1)[0] == whole[i]).all()


def test_near_dedup_odd_rows(spark, odd, none):
    rows = near_dedup.classes(spark, odd).collect()
    assert len(rows) == odd.count()
    assert sorted(r.doc_id for r in rows if r.class_id == 1) == [1, 1, 2]
    assert {r.class_id for r in rows if r.doc_id in (3, 4, 6)} == {3, 4, 6}
    assert all(r.is_first for r in rows if r.doc_id is None)
    assert near_dedup.classes(spark, none).count() == 0
    assert near_dedup.keep_one(spark, odd).count() == odd.count() - 1


# -- the pipeline


def test_pipeline_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    language = language_id.identify(spark, table(spark, SF, "documents"))
    left = {i: docs[i] for i in [r.doc_id for r in language.filter("not rejected").collect()]}
    first: dict[str, int] = {}
    for i in sorted(left):
        first.setdefault(" ".join(x for x in __import__("re").split(r"[ \t-\r]+", left[i])), i)
    left = {i: docs[i] for i in first.values()}
    left = {i: docs[i] for i, c in brute_classes(left).items() if i == c}
    shared = set().union(*(grams(t) for _, t in items))
    near = [(i, t) for i, t in left.items() if shared & set(grams(t))]
    bad = {d for d, _ in brute_hits(near, items)}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(left) - bad and all(r.round_trip for r in rows)


def test_stages_keep_the_columns(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns
        docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.columns == [c for c in odd.columns if c != "ids"] + ["n_tokens", "ids", "round_trip"]
    assert last.count() == docs.count() and last.filter("not round_trip").count() == 0


def test_pipeline_of_nothing(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
