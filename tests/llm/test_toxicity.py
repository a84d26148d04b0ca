import math
import random
import re
import zlib

import duckdb
import pytest

from shelfspark.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def made(n, seed=0, noise=0.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choices("bcdfghkmnr", k=2)) + rng.choice("aeo") + "".join(rng.choices("bcdfghkmnr", k=2)) for _ in range(rng.randint(5, 300))]
        toxic = rng.random() < 0.3
        if toxic and rng.random() >= noise:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["blorp", "zarkest", "zarking", "zarku"]))
        if rng.random() < 0.2:
            words[rng.randrange(len(words)) : 0] = ["blorp", "proof"]
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    rows = made(900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    return docs, labels, toxicity.train(docs, labels)


def spared(words, i, lexicon):
    return any(words[j : j + len(p)] == p for p in map(str.split, lexicon.phrases) for j in range(max(0, i - len(p) + 1), i + 1))


def test_folding():
    assert toxicity.folded("Idiot ІDІОТ 1d10t id!ot |d1Øt ídïot ｉｄｉｏｔ id​iot!") == ["idiot"] * 4 + ["idiøt", "idiot", "idiot", "idiot"]
    assert toxicity.folded("l0ser,$tupid;tr@sh") == ["ioser", "stupid", "trash"]
    assert toxicity.folded(None) == toxicity.folded(" \t!!! $ @") == []
    assert toxicity.folded("naïve Straße") == ["naive", "strasse"]


def test_matches_equal_brute_force(learned):
    _, _, lexicon = learned
    matcher = toxicity.Matcher(lexicon)
    for _, text, label in made(150, 5):
        words = toxicity.folded(text)
        for own in (None, label):
            want = {}
            for i, w in enumerate(words):
                found = [(lexicon.strength(t, own), t) for t in [f" {w} ", *[f" {w[:k]}" for k in range(1, len(w) + 1)]] if t in lexicon.terms]
                best = max(found, default=(0.0, ""))
                if best[0] > 0 and not spared(words, i, lexicon):
                    want[i] = best[0]
            got = matcher.hits(words, own)
            assert {i: s for i, (_, s) in got.items()} == want
            assert matcher.level(words, got) == math.log1p(toxicity.PER * sum(want.values()) / (len(words) + toxicity.LENGTH))


def test_stems_are_terms_and_mild_phrases_are_exceptions(learned):
    _, _, lexicon = learned
    assert " zark" in lexicon.terms
    assert "biorp proof" in lexicon.phrases


def test_counts_equal_brute_force(learned):
    docs, labels, lexicon = learned
    toxic = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    held = [(toxicity.folded(r.text), toxic[r.doc_id]) for r in docs.collect() if r.doc_id in toxic]
    assert (lexicon.toxic, lexicon.clean) == (sum(x for _, x in held), sum(1 - x for _, x in held))
    for term, (t, c) in lexicon.terms.items():
        word, whole = term.strip(), term.endswith(" ")
        has = [(any((w == word if whole else w.startswith(word)) and not spared(words, i, lexicon) for i, w in enumerate(words)), x) for words, x in held]
        assert (t, c) == tuple(sum(h for h, x in has if x == k) for k in (1, 0))


def test_terms_of_a_document():
    assert toxicity.terms_of(["abcd", "abcdef", "abc"]) == {" abcd ", " abcd", " abcdef ", " abcde", " abcdef", " abc "}


def test_a_mild_word_that_shares_a_stem(spark):
    # Words that start with "grumpel" tell toxic documents, but "grumpelo" doesn't, and neither does "grumpel soup".
    rng = random.Random(2)
    rows = []
    for i in range(1200):
        kind = i % 4
        word = f"grumpel{rng.choice('abcdefghijkmn')}{rng.choice('aeu')} end" if kind < 2 else "grumpelo more" if kind == 2 and i % 3 == 0 else "grumpel soup" if kind == 2 and i % 3 == 1 else "nothing else"
        rows.append((i, f"w{i % 7} {word}", int(kind < 2)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lexicon = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert {"grumpeio", "grumpei soup"} <= set(lexicon.phrases)
    got = {r.doc_id: r.score for r in toxicity.classify(docs, lexicon).collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == bool(x) for i, _, x in rows)


def test_evidence_is_the_statistic_of_the_table():
    a, b, c, d = 8.5, 1.5, 32.5, 230.5
    n = a + b + c + d
    want = 2 * sum(o * math.log(o * n / (r * k)) for o, r, k in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)))
    assert toxicity.evidence(8, 1, 40, 231) == pytest.approx(want)
    assert toxicity.weight(8, 1, 40, 231) == pytest.approx(math.log((8.5 / 41) / (1.5 / 232)))


def test_unseen_documents(spark, learned):
    docs, labels, lexicon = learned
    rows = made(400, 11)
    out = toxicity.classify(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), lexicon)
    got = {r.doc_id: r.score for r in out.collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == bool(x) for i, _, x in rows)
    obscured = spark.createDataFrame([(1, "kaba ΒL0RΡ mendo"), (2, "kaba zаrk1ng ndo"), (3, "kaba mendo")], "doc_id long, text string")
    assert [r.score >= toxicity.THRESHOLD for r in toxicity.classify(obscured, lexicon).collect()] == [True, True, False]
    again = toxicity.train(docs.repartition(5), labels)
    assert again == lexicon


def test_a_chance_word_of_one_class_is_no_term(spark):
    rows = [(i, f"same words each time and once{i}", int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lexicon = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert lexicon.terms == {}
    assert toxicity.classify(docs.limit(1), lexicon).first().score == pytest.approx(0.25, abs=0.03)


def test_without_labels_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "p"), (2, "", "q"), (2, "", "q"), (None, "x " * 50_000, "r")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (99, 1), (None, 0)], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, labels)
    out = toxicity.classify(docs, lexicon)
    assert out.columns == ["doc_id", "text", "score", "hits"]
    assert [(r.score, r.hits) for r in out.collect()] == [(0.5, [])] * 4
    assert toxicity.classify(docs.limit(0), lexicon).collect() == []
    for k in (0, 1):
        one = toxicity.train(docs, spark.createDataFrame([(1, k), (2, k)], "doc_id long, toxic int"))
        assert all((r.score > 0.5) == bool(k) for r in toxicity.classify(docs, one).collect())


def test_the_query_on_rows_that_it_has_not_learned_from(spark):
    got = {r.doc_id: r for r in queries.op12_toxicity(spark, SF).collect()}
    con = duckdb.connect()
    assert len(got) == con.execute(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    insults = re.compile("loser|idiot|pathetic|scum|worthless|moron|trash|clown|disgusting|stupid")
    caught = missed = wrong = 0
    for doc_id, text, toxic in con.execute(f"SELECT doc_id, text, toxic FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id)").fetchall():
        r = got[doc_id]
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.7)
        if r.held_out:
            # Some labels of the table are marked at random; these documents hold nothing that tells.
            tells = toxic == 1 and bool(insults.search((text or "").lower()))
            caught += tells and r.predicted
            missed += tells and not r.predicted
            wrong += toxic == 0 and r.predicted
    assert caught >= 8
    assert missed <= 1
    assert wrong <= 2
