"""The text operators: small odd tables, and brute force or SQL on the given ones."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import compare
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F
from seqcurate.llm import bpe, graph, lid, lines, merkle, minhash, mixing, pii, quality, rules, toxicity
from seqcurate.llm.common import number_rows
from seqcurate.llm.queries import ORACLES, QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def texts(sf_dir, spark):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    assert compare.difference(QUERIES[name](spark, sf_dir), compare.connect(sf_dir), ORACLES[name]) is None


def groups(sets, percent=75):
    """Smallest id reachable by links, by plain counting."""
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    where = defaultdict(list)
    for i in sorted(sets):
        count = defaultdict(int)
        for s in sets[i]:
            for j in where[s]:
                count[j] += 1
            where[s].append(i)
        for j, n in count.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def word_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark, sf_dir, texts):
    got = QUERIES["op1_circulant_minhash"](spark, sf_dir).toPandas().set_index("doc_id")
    sets = {i: word_set(t) for i, t in zip(texts.doc_id, texts.text)}
    assert got.n_shingles.to_dict() == {i: len(s) for i, s in sets.items()}
    assert got.component_id.to_dict() == groups(sets)
    assert (got.kept == (got.index == got.component_id)).all()


def test_near_copies_around_a_hub(spark):
    """Copies that are linked with the original but not with one another stay one group."""
    rng = random.Random(5)
    hub = [f"w{k}" for k in range(200)]
    docs = [(500, " ".join(hub))]
    for k in range(120):
        own = list(hub)
        for at in rng.sample(range(0, 200, 6), rng.randint(2, 9)):
            own[at] = f"x{k}.{at}"
        docs.append((k, " ".join(own)))
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert got.component_id.to_dict() == groups({i: word_set(t) for i, t in docs})


def test_near_duplicates_odd(odd_docs, no_docs):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd_docs).collect())
    by_id = {r[1]: r[2:] for r in got if not r[0]}
    assert len(got) == 12 and by_id[1][1:] == (1, True) and by_id[2][1:] == (1, False) and by_id[3][1:] == (1, False)
    assert by_id[4] == (0, 4, True) and by_id[6] == (0, 6, True) and by_id[8] == (1, 8, True)
    assert [r[2:] for r in got if r[0]] == [(16, None, True)]
    assert minhash.near_duplicates(no_docs).count() == 0


def test_circulant_ranks_are_permutations():
    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(minhash._permute(x.copy()))) == len(x)
    a, b = np.arange(0, 3000, dtype=np.uint64) * np.uint64(7919), np.arange(500, 3500, dtype=np.uint64) * np.uint64(7919)
    same = np.mean(minhash.signature(a, 512) == minhash.signature(b, 512))
    assert abs(same - 2500 / 3500) < 0.08


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(None, 4), (7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {a: root(a) for a in list(parent)}


@pytest.mark.parametrize("op, parts, remainder, label", [("op2_quality_classifier", 4, 2, "quality"), ("op10_toxicity", 5, 0, "toxic")])
def test_classifiers(spark, sf_dir, op, parts, remainder, label):
    got = QUERIES[op](spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % parts == remainder for i in got.doc_id]).all()
    held = got.merge(labels, on="doc_id").query("held_out")
    assert (held.predicted == held[label]).mean() > 0.85


def test_toxicity_finds_marked_texts(spark):
    rng = random.Random(1)
    plain = lambda: " ".join("".join(rng.choices(["ba", "ko", "ri", "tu", "me"], k=rng.randint(2, 4))) for _ in range(60))
    rows = [(k, plain() + (" zzwox zzwoxe" if k % 3 == 0 else "")) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(400)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") < 300)
    got = toxicity.score(docs, model, ["doc_id"]).where("doc_id >= 300").toPandas()
    assert ((got.score >= 0.5) == (got.doc_id % 3 == 0)).mean() > 0.95


def test_toxicity_counts_all_rows(spark):
    """An ending that two labelled rows show speaks for their class, whichever rows they are."""
    rng = random.Random(4)
    syllables = ["ba", "ko", "ri", "tu", "me"]
    plain = lambda: " ".join("".join(rng.choices(syllables, k=3)) for _ in range(30))
    marks = [syllables[3 * k % 5] + syllables[k % 5] + "qxzwvjyf"[k // 5] for k in range(40)]
    docs = [(k, f"{plain()} {marks[k % 40]}") for k in range(80)] + [(80 + k, plain()) for k in range(80)] + [(1000 + k, marks[k]) for k in range(40)]
    labels = spark.createDataFrame([(k, int(k < 80)) for k in range(160)], "doc_id long, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = toxicity.score(frame, toxicity.train(frame, labels, F.lit(True)), ["doc_id"]).where("doc_id >= 1000").toPandas()
    assert len(got) == 40 and (got.evidence > 0.1).all(), sorted(got.evidence)


def test_classifiers_odd(odd_docs, no_docs, odd_labels):
    for docs, labels in ((odd_docs, odd_labels), (odd_docs, odd_labels.limit(0)), (no_docs, odd_labels)):
        n = docs.count()
        for module, label in ((quality, "quality"), (toxicity, "toxic")):
            got = module.score(docs, module.train(docs, labels, F.lit(True), label), ["doc_id", "text", "score"], "p").toPandas()
            assert len(got) == n and got.p.between(0, 1).all()
            blank = got[got.text.isna() | (got.text == "")]
            assert blank.p.nunique() <= 1


def test_language(spark, sf_dir, odd_docs, no_docs):
    got = QUERIES["op6_language_mixture"](spark, sf_dir).toPandas()
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas()
    held = got.merge(truth, on="doc_id").query("held_out")
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()
    odd = {r["doc_id"]: r for r in lid.predict(odd_docs, lid.train(odd_docs, F.lit(True)), ["doc_id"]).collect()}
    assert {odd[k]["lang_pred"] for k in (4, 5, 6)} == {"und"} and odd[1]["lang_pred"] == "en"
    assert lid.predict(odd_docs, lid.train(no_docs, F.lit(True)), ["doc_id"]).where("lang_pred != 'und'").count() == 0


def test_language_mixture_selects_both():
    names, texts = ["x", "y"], {"x": "abra kadabra barka " * 30, "y": "moto lumo tulmo " * 30}
    table = np.full((2, lid.BUCKETS), lid.SMOOTHING)
    for k, n in enumerate(names):
        table[k] += lid.counts(texts[n])
    logp = np.log(table / table.sum(axis=1, keepdims=True)).T
    found, shares = lid.infer("abra kadabra barka moto lumo tulmo " * 5, names, logp)
    assert sorted(found) == names and abs(shares.sum() - 1) < 1e-6
    assert lid.infer("abra barka", names, logp)[0] == ["x"]


def test_personal_data(spark, sf_dir, texts):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip, card, phone = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def plain(text):
        digits = lambda s: re.findall("[0-9]", s)
        found = [("email", m.span()) for m in email.finditer(text)]
        found += [("ip", m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        found += [("card", m.span()) for m in card.finditer(text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn("".join(digits(m[0])))]
        return found + [("phone", m.span()) for m in phone.finditer(text) if 8 <= len(digits(m[0])) <= 15]

    got = QUERIES["op3_disclosure"](spark, sf_dir).toPandas().set_index("doc_id")
    for i, text in zip(texts.doc_id, texts.text):
        want = ",".join(f"{k}:{a}:{b}" for k, (a, b) in plain(text))
        assert got.base_sha256[i] == hashlib.sha256(want.encode()).hexdigest()
        assert ",".join(s for s in got.spans[i].split(",") if not s.startswith("term")) == want


def test_disclosing_terms(spark, odd_docs, no_docs):
    rng = random.Random(4)
    word = lambda: rng.choice(["lorem", "ipsum", "dolor", "amet", "sitam", "elitr"])
    near = lambda n: " ".join(word() for _ in range(n))
    rows = [(k, f"{near(30)} write Quibblesworth at q@w.org {near(20)}") for k in range(6)] + [(k, near(60)) for k in range(6, 80)]
    rows.append((80, "Nobody but Quibblesworth " + near(10)))
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], rewrite=True).collect()}
    assert "[name]" in got[80]["sanitised"] and "Quibblesworth" not in got[80]["sanitised"] and got[40]["spans"] == ""
    assert "q@w.org" not in got[0]["sanitised"] and "[email]" in got[0]["sanitised"]
    odd = {r["doc_id"]: r for r in pii.find(odd_docs, ["doc_id"]).collect()}
    assert odd[9]["spans"] == "email:5:12" and odd[4]["spans"] == "" and pii.find(no_docs, ["doc_id"]).count() == 0


def test_fingerprints(spark, sf_dir, texts):
    got = QUERIES["op4_merkle"](spark, sf_dir).toPandas().set_index("doc_id")
    all_texts = texts.text.tolist()
    for k, (i, text) in enumerate(zip(texts.doc_id, all_texts)):
        half = len(text) // 2
        edited = text[: len(text) - half] + all_texts[(k + 1) % len(all_texts)][:half]
        assert got.n_chars[i] == len(text) and got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest()
    by_text = got.join(texts.set_index("doc_id")).groupby("text").fingerprint.nunique()
    assert (by_text == 1).all() and got.fingerprint.nunique() == texts.text.nunique()
    assert got.near_edited.between(0, 1).all() and got.near_edited.mean() > got.near_next.mean() + 0.1


def test_fingerprints_odd(spark, odd_docs, no_docs):
    got = merkle.fingerprints(odd_docs).toPandas()
    assert len(got) == 12 and merkle.fingerprints(no_docs).count() == 0
    assert got[got.doc_id.isin([1, 2]) | got.doc_id.isna()].fingerprint.nunique() == 1
    pair = spark.createDataFrame([("A one. A two.\nB.\nC.", "A one. A two.\nB changed.\nC.")], "a string, b string")
    r = pair.select(merkle.differences(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("d"), merkle.likeness(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("l")).first()
    assert len(r["d"]) == 1 and r["l"] == 3 / 5


def test_native_plans(spark, sf_dir):
    for name in ("op4_merkle", "op9_line_rules"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_schedule_deviation():
    for weights in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 90.0, **{f"s{k}": 0.1 for k in range(40)}}, {None: 1.0, "": 2.0}):
        quota = mixing.quotas(weights)
        slots = mixing.frame_slots(quota)
        assert sum(quota.values()) == mixing.FRAME and [s[2] for s in slots] == list(range(mixing.FRAME))
        assert all(r <= slot < due for _, _, slot, r, due in slots)
        done = dict.fromkeys(quota, 0)
        for source, _, slot, _, _ in slots:
            done[source] += 1
            assert all(abs(done[s] - quota[s] * (slot + 1) / mixing.FRAME) < 1 for s in quota)


def test_mixing(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(k, "a" if k % 3 else "b" if k % 2 else None) for k in range(3000)], "doc_id long, source string")
    got = mixing.schedule(docs, {"a": 1.0, "b": 1.0, None: 2.0}).toPandas()
    assert len(got) == 3000 and got.doc_id.is_unique
    taken = got[got.selected]
    per_slot = taken.groupby("slot")["source"].apply(lambda s: s.iloc[0])
    assert (taken.groupby("slot").size() <= mixing.BLOCK).all() and per_slot.index.tolist() == list(range(len(per_slot)))
    assert abs((per_slot.isna()).mean() - 0.5) < 0.05
    assert mixing.schedule(odd_docs).count() == 12 and mixing.schedule(no_docs).count() == 0
    rows = number_rows(docs, "source", [F.col("doc_id")], 8).toPandas()
    assert all(sorted(g._row) == list(range(len(g))) for _, g in rows.groupby("source", dropna=False))


def test_mixing_goes_on(spark):
    """A tiny source, a hot one, repeated and null ids: every row has a slot, within the windows of a plain schedule."""
    rows = [(k, f"hot {k}", "hot") for k in range(4000)] + [(k, f"{k}", "even") for k in range(1500)] + [(1, "x", "tiny"), (2, "y", None)]
    rows += [(7, f"again {k}", "even") for k in range(40)] + [(None, f"none {k}", "hot") for k in range(40)] + [(7, "same", "even")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.schedule(docs).toPandas()
    assert len(got) == len(rows) and got.slot.notna().all() and (got.release <= got.slot).all() and (got.slot < got.deadline).all()
    blocks = got.drop_duplicates("slot").sort_values("slot")
    assert blocks.slot.tolist() == list(range(len(blocks))) and (got.groupby("slot").size() <= mixing.BLOCK).all()
    # Plain: each slot is shared by the sources that still have blocks, by weight.
    size = got.source.fillna("-").value_counts()
    left, weight = {s: float(-(-n // mixing.BLOCK)) for s, n in size.items()}, {s: n**mixing.SMOOTHING for s, n in size.items()}
    ahead = dict.fromkeys(left, 0.0)
    for source in blocks.source.fillna("-"):
        room = 1.0
        while room > 1e-9 and (active := [s for s in left if left[s] > 1e-9]):
            total = sum(weight[s] for s in active)
            step = min(room / total, *[left[s] / weight[s] for s in active])
            for s in active:
                left[s] -= step * weight[s]
                ahead[s] -= step * weight[s]
            room -= step * total
        ahead[source] += 1
        assert all(abs(x) < 1 + 1e-6 for x in ahead.values())
    mixed = corpus_pipeline.mixing_stage(spark, docs, "")
    assert mixed.columns == docs.columns and sorted(mixed.collect(), key=str) == sorted(docs.collect(), key=str)


def test_true_weights():
    """Shares over ten frames stay within one block of the weights themselves, also of a weight below a slot a frame."""
    slots = 10 * mixing.FRAME
    for weights in ([1 / 40960, 0.3, 0.7 - 1 / 40960], [0.1] * 7 + [0.3], [0.5 / 5000] * 5000 + [0.5], [n**0.7 for n in (3, 50, 1234, 99999)]):
        total = sum(weights)
        share = [w / total for w in weights]
        blocks = [int(w * slots) + 2 for w in share]
        until = int(min(n / w for n, w in zip(blocks, share)))
        assert until >= slots
        done = np.zeros(len(weights))
        for source, block, slot, release, deadline in mixing.earliest_deadline(weights, blocks):
            if slot >= until:
                break
            assert block == done[source] and release <= slot < deadline
            done[source] += 1
            if slot % 97 == 0 or slot == slots - 1:
                assert (abs(done - np.array(share) * (slot + 1)) < 1 + 1e-6).all()


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPOOL", 1000)
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('domain', id % 5000) AS source")
    got = mixing.schedule(docs).toPandas()
    assert len(got) == 6000 and sorted(got.slot.unique()) == list(range(5000)) and (got.groupby("slot").source.nunique() == 1).all()


def test_bpe(spark, sf_dir, texts, odd_docs, no_docs):
    library = tokenizers.Tokenizer.from_file(PATH)
    got = QUERIES["op7_bpe"](spark, sf_dir).toPandas().set_index("doc_id")
    for i, text in zip(texts.doc_id, texts.text):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got.n_tokens[i] == len(ids) and got.ids_sha256[i] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in bpe.decode(bpe.encode(odd_docs, PATH, "n"), PATH, "back", "n").collect():
        assert r["n"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["back"] == (r["text"] or "")
    assert bpe.encode(no_docs, PATH, "n").count() == 0


def test_fuzzy_lines(spark, sf_dir, texts):
    got = QUERIES["op8_fuzzy_lines"](spark, sf_dir).toPandas().set_index("doc_id")
    places = [(i, k, line.strip(" \t\x0b\f\r")) for i, t in zip(texts.doc_id, texts.text) for k, line in enumerate(t.split("\n"))]
    places = [p for p in places if p[2]]
    number = {}
    for _, _, line in places:
        number.setdefault(line, len(number))
    roots = groups({n: set(lines.line_set(line).tolist()) for line, n in number.items()})
    first, keep = {}, defaultdict(list)
    for i, k, line in places:
        if first.setdefault(roots[number[line]], (i, k)) == (i, k):
            keep[i].append(line)
    wrong = sum([x for x in (y.strip(" \t\x0b\f\r") for y in t.split("\n")) if x] != keep[i] for i, t in got.text.items())
    # Banding finds a pair at the limit with probability 0.996.
    assert wrong <= 2


def test_fuzzy_lines_odd(odd_docs, no_docs):
    got = lines.dedup(odd_docs).toPandas()
    assert len(got) == 12 and set(odd_docs.columns) <= set(got.columns) and lines.dedup(no_docs).count() == 0
    assert got[got.doc_id == 4].text.isna().all() and (got[got.doc_id == 8].text == "Short line.").all()
    # The row without an id comes first; the lines of 1, 2 and 3 are its copies.
    assert got[got.doc_id.isin([1, 2, 3])].emptied.all() and not got[got.doc_id.isna()].emptied.any()


def test_line_rules_odd(odd_docs, no_docs):
    got = {r["doc_id"]: r for r in rules.clean(odd_docs, ["doc_id", "score"]).collect()}
    assert got[4]["n_words"] == 0 and got[4]["base_failed"] and not got[4]["kept"] and got[1]["kept"] and rules.clean(no_docs, ["doc_id"]).count() == 0
    assert got[7]["n_words"] == 15000 and got[7]["kept"]


def test_pipeline(spark, sf_dir, odd_docs, no_docs, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(stage(spark, docs, sf_dir), f"test-{name}")
        assert 0 < docs.count() <= before and (name == "encoding" or docs.columns == columns)
        before = docs.count()
    assert docs.where("decoded != text").count() == 0
    for table in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            table = corpus_pipeline.stage(stage(spark, table, sf_dir), "odd")
