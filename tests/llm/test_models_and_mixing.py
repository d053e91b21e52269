"""Language id, personal data, language model, shards and mixing."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from moltables.llm import crf, gru_lm, langid, mixing, pii, sharding
from moltables.llm.queries import QUERIES
from moltables.llm.viterbi import decode

SF = "/root/testdata/sf0.001"


def test_viterbi_equals_all_paths():
    r = np.random.default_rng(1)
    lengths = [0, 1, 4, 3, 5]
    s, moves, first = r.normal(size=(13, 3)).astype(np.float32), r.normal(size=(3, 3)), r.normal(size=3)
    got, at = decode(s, np.array(lengths), moves, first), 0
    for n in lengths:
        def value(p):
            return sum(s[at + i, k] for i, k in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])) + (first[p[0]] if p else 0)
        assert tuple(got[at:at + n]) == max(itertools.product(range(3), repeat=n), key=value)
        at += n


def test_languages_of_held_out_documents(spark):
    rows = QUERIES["op1_language_id"](spark, SF).collect()
    lang = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 200 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) >= 0.95


def test_spans_of_mixed_text_and_awkward_rows(spark, awkward_docs, empty_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = langid.train(docs.select("lang", "text"))
    de, es = (docs.filter(F.col("lang") == k).filter("n_chars > 300").orderBy("doc_id").first()["text"][:280] for k in ("de", "es"))
    both = spark.createDataFrame([(1, f"{de} {es}"), (2, "Привет мир"), (3, "12 34")], "doc_id long, text string")
    r = {x["doc_id"]: x for x in langid.languages(both, m).collect()}
    assert [s["lang"] for s in r[1]["spans"]] == ["de", "es"] and abs(r[1]["spans"][1]["start"] - 281) < 12
    assert r[3]["lang_pred"] == "und" and r[2]["lang_pred"] in m.langs
    got = langid.languages(awkward_docs, m).collect()
    assert len(got) == awkward_docs.count()
    by = {x["doc_id"]: x for x in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (7, 8, 9)) and 0 < by[12]["score"] <= 1
    assert langid.languages(empty_docs, m).count() == 0
    assert langid.languages(awkward_docs, langid.train(empty_docs.select("lang", "text"))).filter("lang_pred <> 'und'").count() == 0


def test_script_narrows_candidates(spark):
    rows = [("ru", "привет мир это текст"), ("en", "hello world this is text"), ("de", "hallo welt das ist text")] * 3
    m = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    assert m.scripts[langid.SCRIPTS.index("Cyrillic"), m.langs.index("ru")] == 0 and m.scripts[langid.SCRIPTS.index("Cyrillic"), m.langs.index("en")] < -1
    got = langid.languages(spark.createDataFrame([(1, "zzz щщщ")], "doc_id long, text string"), m, penalty=0.5).first()
    assert got["spans"][-1]["lang"] == "ru"


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(KINDS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and max(int(x) for x in m[0].split(".")) <= 255 or kind == "phone" and 9 <= len(d) <= 15
            if kind == "card" and 12 <= len(d) <= 19:
                ok = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_rule_spans_and_awkward_rows(spark, awkward_docs, empty_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, "ä 1.2.3.4.5 300.1.1.1 x@y x@y.z.w. 4111 1111-1111 1111 4111111111111112 +1 (2) 3 +1 (526) 555-9022"), (-2, "é a@b.c\n+49 30 901820")], "doc_id long, text string")
    m = pii.trained(pii.labelled_table(docs))
    both = docs.union(odd)
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    got = pii.personal_data(both, m).collect()
    for r in got:
        want = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",")) | {""} and r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len(want)
    assert sum(r["n_added"] for r in got if r["doc_id"] >= 0) <= 3  # secrets, licences and numbers are left alone
    assert len(pii.personal_data(awkward_docs, m).collect()) == awkward_docs.count() and pii.personal_data(empty_docs, m).count() == 0
    masked = {r["doc_id"]: r for r in pii.masked_documents(awkward_docs, m).collect()}
    assert masked[13]["text"] == "call [PHONE] or mail [EMAIL] now" and masked[13]["n_chars"] == len(masked[13]["text"]) and masked[7]["text"] is None and masked[1]["word"] == "own word"


def test_the_field_finds_forms_that_the_rules_miss():
    m = crf.train(pii.fixed_examples(), pii.LABELS)
    text = "please call me at (212) 555-0199 tonight or pay with 4111.1111.1111.1111 today"
    base, every = pii._spans(m, [text.encode()])
    assert base == [[]] and {k for k, _, _ in every[0]} == {"phone", "card"}
    for kind, lo, hi in every[0]:
        assert text[lo:hi] in ("(212) 555-0199", "4111.1111.1111.1111"), kind


def test_shapes_of_a_long_text_are_those_of_its_pieces(monkeypatch):
    text = ("Ab1 (cd) \n" * 400).encode()
    whole = crf.shapes(text)
    monkeypatch.setattr(crf, "_PIECE", 150)
    assert all(np.array_equal(a, b) for a, b in zip(crf.shapes(text), whole))


def test_the_field_reads_on_after_a_token_longer_than_a_piece(monkeypatch):
    m = crf.train(pii.fixed_examples(), pii.LABELS)
    tail = " please call me at (212) 555-0199 tonight or pay with 4111.1111.1111.1111 today"
    block = "Ab1/" * (crf._PIECE // 2)  # twice a piece, without white space
    for head in ("", " ", "日本語" * 60_000, "short words first "):
        text = head + block + tail
        spans = pii._spans(m, [text.encode()])[1][0]
        assert [(k, text[a:b]) for k, a, b in spans] == [("phone", "(212) 555-0199"), ("card", "4111.1111.1111.1111")]
        assert "0199" not in pii.masked(text, spans)
    texts = [f"{w}Ab1/Ab1/x1 (cd) \n{block[:600]}\tAb1{e}".encode() for w in ("", " ", "a ") for e in ("", " ", "\n")]
    whole = [crf.shapes(t) for t in texts]
    monkeypatch.setattr(crf, "_PIECE", 150)
    for t, w in zip(texts, whole):
        assert all(np.array_equal(a, b) for a, b in zip(crf.shapes(t), w))
    assert len(crf.train([([block], ["O"])], pii.LABELS, rounds=1).known) == 1  # such a token may be in the labelled table


def test_an_ip_part_of_many_zeros():
    assert pii.base_spans(f"at {'0' * 5000}1.2.3.4 now")[0][0] == "ip" and not pii.valid("ip", f"1.2.3.{'0' * 5000}256")


def test_language_model_is_better_and_adds_up_to_one(spark, awkward_docs, empty_docs):
    rows = QUERIES["op7_gru_language_model"](spark, SF).collect()
    texts = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    import zlib
    words = {i: [*t.encode().lower().split(), b""] for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        ws = words[r["doc_id"]]
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert r["held_out"] == held[r["doc_id"]] and r["n_tokens"] == len(ws) and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[w] > 0 for w in ws) and abs(r["base_score"] - want) < 1e-6 * abs(want)
    test = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)
    # All one-word continuations and the unknown shares of the classes: probability one.
    small = spark.createDataFrame([(i, f"a b c{i % 3} a b") for i in range(40)], "doc_id long, text string")
    one = [(100 + i, w) for i, w in enumerate(["a", "b", "c0", "c1", "c2", ""])]
    s = {r["doc_id"]: r for r in gru_lm.language_model_scores(small.union(spark.createDataFrame(one, small.schema)).filter("doc_id < 100 or true")).collect()}
    assert all(r["score"] <= 0 for r in s.values())
    got = gru_lm.language_model_scores(awkward_docs).collect()
    assert len(got) == awkward_docs.count() and all(math.isfinite(r["score"]) for r in got)
    assert gru_lm.language_model_scores(empty_docs).count() == 0


def test_the_network_learns_from_every_training_text(spark, monkeypatch):
    docs = spark.range(4000).select((F.col("id") % 3900).alias("doc_id"), F.when(F.col("id") % 50 > 0, F.concat(F.lit("a b c d "), F.col("id") % 9)).alias("text")).repartition(5)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    counts = texts.mapInArrow(gru_lm._count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).withColumn("tail", F.pmod(F.crc32(F.expr("substring(word, -3)")), F.lit(gru_lm.TAIL)).cast("int"))
    v = gru_lm.vocabulary(counts)
    vocab = spark.sparkContext.broadcast(v)
    assert gru_lm.fitted(texts, v, vocab)[1] == 3 * v.total == 3 * (3920 * 6 + 80)
    monkeypatch.setattr(gru_lm, "TASK_TOKENS", 5000)  # four tasks, four rounds
    assert gru_lm.fitted(texts, v, vocab)[1] == 3 * v.total
    scores = gru_lm.language_model_scores(docs).agg(F.sum("score"), F.sum("base_score")).first()
    assert scores[0] > 0.6 * scores[1]


def test_a_small_training_set_is_learned_from(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))  # about 1350 tokens
    r = gru_lm.language_model_scores(docs).agg(F.sum("score"), F.sum("base_score"), F.max("train_tokens")).first()
    assert r[2] < 2304 and r[0] > 0.9 * r[1]


def test_first_word_probabilities_sum_to_one():
    head = 6
    head_class = np.array([0, 0, 1, 1, 2, 3])
    start = np.searchsorted(head_class, np.arange(gru_lm.HEAD_CLASSES + 1))
    r = np.random.default_rng(2)
    p = {k: r.normal(size=s).astype(np.float32) for k, s in gru_lm._shapes(head).items()}
    # Classes without a head word keep their mass; it belongs to nobody here.
    logs = gru_lm.sequence_scores(p, head_class, start, [np.array([k]) for k in range(head + gru_lm.TAIL)])
    table = p["emb"] @ p["wx"] + p["bx"]
    hs, *_ = gru_lm._run(p, table, np.array([[head + gru_lm.TAIL]]), np.zeros((1, gru_lm.HIDDEN), np.float32), head + gru_lm.TAIL, False)
    c = np.exp(gru_lm._log_softmax(hs[0] @ p["wc"] + p["bc"]))[0]
    assert abs(np.exp(logs).sum() + c[4:gru_lm.HEAD_CLASSES].sum() - 1) < 1e-4


def test_state_is_carried_over_windows_and_lanes(monkeypatch):
    head_class = np.zeros(5, np.int64)
    start = np.searchsorted(head_class, np.arange(gru_lm.HEAD_CLASSES + 1))
    r = np.random.default_rng(3)
    p = {k: (r.normal(size=s) * 0.2).astype(np.float32) for k, s in gru_lm._shapes(5).items()}  # calm, so rounding does not grow
    seqs = [r.integers(0, 5 + gru_lm.TAIL, n) for n in (1, 200, 33, 64, 7, 90)]
    whole = gru_lm.sequence_scores(p, head_class, start, seqs)
    monkeypatch.setattr(gru_lm, "LANES", 2)
    monkeypatch.setattr(gru_lm, "STEPS", 7)
    assert np.allclose(gru_lm.sequence_scores(p, head_class, start, seqs), whole, atol=1e-3)


def test_gradient_of_the_network():
    head_class = np.array([0, 0, 1, 1, 1])
    start = np.searchsorted(head_class, np.arange(gru_lm.HEAD_CLASSES + 1))
    r = np.random.default_rng(4)
    p = {k: r.normal(size=s) * 0.5 for k, s in gru_lm._shapes(5).items()}
    begin = 5 + gru_lm.TAIL
    x, y = np.array([[begin, 3], [1, begin], [20, 4]]), np.array([[1, 2], [20, 4], [0, 30]])

    def loss(q):
        hs, *_ = gru_lm._run(q, q["emb"] @ q["wx"] + q["bx"], x, np.zeros((2, gru_lm.HIDDEN)), begin, False)
        return -gru_lm._outputs(q, hs.reshape(-1, gru_lm.HIDDEN).astype(float), y.ravel(), head_class, start)[0].sum()
    hs, _, saved, fresh = gru_lm._run(p, p["emb"] @ p["wx"] + p["bx"], x, np.zeros((2, gru_lm.HIDDEN)), begin, True)
    grads = {}
    _, dh = gru_lm._outputs(p, hs.reshape(-1, gru_lm.HIDDEN).astype(float), y.ravel(), head_class, start, grads)
    gru_lm._backward(p, x, dh.reshape(hs.shape), saved, fresh, grads)
    for k in p:
        at = tuple(r.integers(0, n) for n in p[k].shape) if k not in ("emb",) else (3, 5)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        assert grads[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-3, abs=2e-2)


def test_shards(spark, awkward_docs, empty_docs):
    rows = QUERIES["op4_virtual_slot_shards"](spark, "/root/testdata/sf0.01").collect()
    load, places = defaultdict(int), defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    mean = sum(load.values()) / 24
    assert set(load) == set(range(24)) and max(load.values()) - min(load.values()) < 0.01 * mean
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    d, slot_map, totals = sharding.sharded(awkward_docs, shards=3, slots=64)
    assert d.count() == awkward_docs.count() and {r["shard"] for r in d.collect()} <= {0, 1, 2}
    old = {r["vslot"]: r["shard"] for r in slot_map.collect()}
    grown = sharding.grown_map(slot_map, totals, 3).collect()
    assert {r["version"] for r in grown} == {2} and all(r["shard"] in (old[r["vslot"]], 3) for r in grown)
    d, slot_map, totals = sharding.sharded(empty_docs)
    assert d.count() == 0 and slot_map.count() == 0


def test_map_edits_keep_most_slots(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    _, slot_map, totals = sharding.sharded(docs, shards=8, slots=512)
    load = lambda m: {r["shard"]: r["b"] for r in m.join(totals, "vslot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    grown = load(sharding.grown_map(slot_map, totals, 8))
    mean = sum(grown.values()) / 9
    assert len(grown) == 9 and all(abs(v - mean) < 0.12 * mean for v in grown.values())
    skewed = slot_map.withColumn("shard", F.when(F.col("shard") < 4, F.lit(0)).otherwise(F.col("shard")))
    fixed = sharding.rebalanced_map(skewed, totals, 8)
    after = load(fixed)
    mean = sum(after.values()) / 8
    assert fixed.count() == slot_map.count() and all(abs(v - mean) < 0.15 * mean for v in after.values())
    kept = fixed.alias("a").join(skewed.alias("b"), "vslot").filter("a.shard = b.shard and a.shard >= 4").count()
    assert kept == skewed.filter("shard >= 4").count()


def test_mixing_targets(spark, awkward_docs, empty_docs):
    shares = spark.createDataFrame([("a", 700, 0.7), ("b", 200, 0.2), ("c", 100, 0.1)], "source string, tokens long, share double")
    power = mixing.bisected_power(shares, max_repetition=2.0)
    assert abs(power - (1 - math.log(2) / math.log(7))) < 1e-5
    low = mixing.bisected_power(shares, min_entropy=1.0)
    w = np.array([0.7, 0.2, 0.1]) ** low
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 1.0) < 1e-4
    assert mixing.bisected_power(shares, max_repetition=10.0) == 0 and mixing.bisected_power(shares, min_entropy=9.0) == 0
    plan, sources = mixing.mixed(awkward_docs, max_repetition=3.0)
    rows, budget = plan.collect(), {r["source"]: r for r in sources.collect()}
    got = Counter()
    for r in rows:
        got[r["source"]] += r["tokens"]
    for s, b in budget.items():
        assert got[s] <= b["budget"] < got[s] + 20_000 + b["tokens"] and b["epochs"] >= 1
    assert Counter(r["doc_id"] for r in rows if r["epoch"] == 1) == Counter(r["doc_id"] for r in awkward_docs.collect())
    docs = mixing.mixed_documents(awkward_docs, max_repetition=3.0)
    assert docs.columns == awkward_docs.columns and Counter(r["doc_id"] for r in docs.collect()) == Counter(r["doc_id"] for r in rows)
    assert {r["block"] for r in docs.select("block").collect()} == {"own block"}
    assert mixing.mixed(empty_docs)[0].count() == 0 and mixing.mixed_documents(empty_docs).count() == 0
    few, _ = mixing.mixed(awkward_docs, budget_tokens=1000, max_repetition=3.0)
    assert sum(r["tokens"] for r in few.collect()) <= 1000
