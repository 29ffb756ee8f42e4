import random

import numpy as np

from quillstone.llm import subjects

TERMS = {"sea": "trawler herring cod quota fishery salmon gillnet oyster".split(), "law": "court appeal writ pleading lawyer dispute ruling hearing".split(), "ice": "glacier frost iceberg skating rink snowfall polar tundra".split()}
FRAMES = ["The branch took over {} from Norvik.", "Demand for {} grew most there.", "Members discussed {} at length."]
PLAIN = ["The seat has moved.", "Accounts were adopted by the board.", "Capital stands at 100 000 now.", "Article 4 was amended."]


def document(rng, main, passing):
    s = [rng.choice(FRAMES).format(rng.choice(TERMS[main])) for _ in range(rng.randint(3, 6))]
    s += [rng.choice(FRAMES).format(rng.choice(TERMS[passing])) for _ in range(rng.randint(0, 2))] if passing != main else []
    s += [rng.choice(PLAIN) for _ in range(rng.randint(1, 4))]
    rng.shuffle(s)
    return " ".join(s)


def corpus(n=500, seed=3):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        main, passing = rng.choice(sorted(TERMS)), rng.choice(sorted(TERMS))
        docs.append((i, document(rng, main, passing), "clash"))
        truth[i] = main
    return docs, truth


def test_held_out_accuracy_and_wrong_labels(spark):
    docs, truth = corpus()
    rng = random.Random(9)
    labels = [(i, truth[i] if rng.random() > 0.07 else rng.choice(sorted(TERMS)), "x") for i in range(300)] + [(1, truth[1], "x"), (9999, "sea", "x"), (2, "unknown", "x"), (None, "sea", "x"), (3, None, "x")]
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, " \n ", "x"), (None, docs[0][1], "x"), (1003, " ".join(p for p in PLAIN) * 500, "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    lab, areas = spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string"), spark.createDataFrame([(s,) for s in TERMS] + [(None,)], "subject string")
    got = {(r.doc_id, r.subject) for r in subjects.assign(d, lab, areas).collect()}
    held = {(i, s) for i, s in truth.items() if i >= 300}
    found = {g for g in got if 300 <= g[0] < 500}
    assert len(found & held) / len(held) > 0.95 and len(found & held) / len(found) > 0.95
    assert not {g for g in got if g[0] >= 1000}
    assert subjects.assign(d.limit(0), lab, areas).count() == 0
    assert subjects.assign(d, lab.limit(0), areas).count() == 0


def sentences(text):
    numbers = subjects.Numbers()
    laid = subjects.lay([text], numbers)
    return [[numbers.words[k] for k in part] for part in np.split(laid.word, laid.start[1:])] if len(laid.start) else []


def test_sentences_and_features():
    assert sentences("A b 12. <p>C d!</p> e\nf. ») G") == [["a", "b"], ["c", "d"], ["e", "f"], ["g"]]
    assert sentences(None) == [] and sentences(" 12. ") == []
    assert len(subjects.features("ab")) == 1 and len(subjects.features("fishery")) > 10


def test_texts_of_a_batch_keep_apart():
    laid = subjects.lay(["a b", None, "", "c. d", "7"], subjects.Numbers())
    assert laid.word.tolist() == [2, 3, 4, 5] and laid.start.tolist() == [0, 2, 3] and laid.text.tolist() == [0, 3, 3]


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    c = subjects.Chunk.unpack(subjects.Chunk.of(["herring cod. law court", "ice and frost"], [[0], [1, 2]], 3).pack())
    w = [rng.normal(0, 0.5, (subjects.BUCKETS, subjects.SIZE)), rng.normal(0, 0.5, (subjects.SIZE, 3)), rng.normal(0, 1, 3)]

    def loss():
        of_word = np.add.reduceat(w[0][c.buckets], c.first, axis=0)
        n = np.add.reduceat(c.n_features[c.word], c.start)
        z = np.add.reduceat(of_word[c.word], c.start, axis=0) / n[:, None] @ w[1] + w[2]
        return float((np.logaddexp(0, z) - z * c.labels[c.doc]).sum())

    n, touched, emb, out, off = c.gradient(*w, False, 3)
    assert n == 3 and set(touched) == set(c.buckets.tolist())
    for value, at, slope in [(w[0], (touched[5], 3), emb[5, 3]), (w[1], (2, 1), out[2, 1]), (w[2], 0, off[0])]:
        was = value[at]
        value[at] = was + 1e-4
        up = loss()
        value[at] = was - 1e-4
        assert abs((up - loss()) / 2e-4 - slope) < 1e-3
        value[at] = was


def test_more_subjects_than_bits_of_a_number(spark):
    names = [f"s{i:03d}" for i in range(70)]
    docs = [(i, f"Word{names[i % 70]}q here. Word{names[i % 70]}q there. Word{names[i % 70]}q again. Nothing else stands here.") for i in range(700)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, names[i % 70]) for i in range(560)], "doc_id bigint, subject string")
    got = {(r.doc_id, r.subject) for r in subjects.assign(d, lab, spark.createDataFrame([(s,) for s in names], "subject string")).collect() if r.doc_id >= 560}
    want = {(i, names[i % 70]) for i in range(560, 700)}
    assert {s for _, s in got & want} >= set(names[62:]) and len(got & want) > 0.9 * len(want)
