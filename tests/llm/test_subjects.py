import random
import re

import numpy as np
from conftest import rows

from kelpie.llm import subjects as S

TOPICS = {
    "law": ["tenancy agreement", "appeal court", "limitation clause", "trial date", "witness oath", "patent claim"],
    "music": ["string quartet", "minor scale", "melody sketch", "oboe tuning", "choir stand", "drum pattern"],
    "sport": ["relay squad", "lap record", "goal keeper", "cup draw", "training camp", "referee report"],
    "science": ["isotope ratio", "vacuum chamber", "plasma density", "control sample", "telescope mirror", "sediment core"],
    "finance": ["yield curve", "pension fund", "credit rating", "tax reserve", "share buyback", "invoice backlog"],
    "farming": ["winter wheat", "soil moisture", "dairy herd", "pest trap", "barley harvest", "silage clamp"],
}
STOCK = ["Status is unchanged since the last session.", "The owner will confirm it before long.", "Nothing else is blocked by this entry."]
SHAPES = ["More detail on the {} and the {} is needed.", "We compared the {} with the {} once more.", "Nobody had updated the {} since the {} changed."]


def test_sentences():
    text = "# A heading\n\nTitle line\nFirst sentence here. Second one follows!Third is glued on.\n- an item that is a sentence without a stop but long\n- short item\n\nWrapped sentence goes\nover two lines here.\r\n&amp;quot;Caf&eacute; au lait&quot; is good."
    assert S.sentences(text) == [
        "First sentence here.", "Second one follows!", "Third is glued on.", "an item that is a sentence without a stop but long", "Wrapped sentence goes over two lines here.", '"Café au lait" is good.',
    ]
    assert S.sentences(None) == [] and S.sentences("") == []


def corpus(n=600):
    random.seed(7)
    data, truth = [], {}
    for i in range(n):
        main, other = random.sample(list(TOPICS), 2)
        topics = [main] * 6 + ([other] * 4 if i % 5 == 0 else [other] if i % 5 == 1 else [])
        if i % 40 == 3:
            topics = []
        said = [random.choice(SHAPES).format(*random.sample(TOPICS[t], 2)) for t in topics] + random.sample(STOCK, 2)
        random.shuffle(said)
        data.append((i, " ".join(said), "clash"))
        truth[i] = {t for t in topics if topics.count(t) / len(topics) >= 0.25}
    return data, truth


def test_documents(spark):
    data, truth = corpus()
    docs = spark.createDataFrame([*data, (1000, None, "c"), (1001, "", "c"), (1002, data[0][1], "c")], "doc_id long, text string, subject string")
    labels = [(i, i, s) for i in range(0, 600, 4) for s in truth[i]] + [(900, None, "law"), (901, 5, None), (902, 6, "unknown"), (903, 4, "music")]
    found = S.document_subjects(
        docs, spark.createDataFrame(labels, "label_id long, doc_id long, subject string"), spark.createDataFrame([(s, "") for s in TOPICS], "subject string, description string")
    ).collect()
    got: dict[int, set] = {}
    for r in found:
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    right = sum(got.get(i, set()) == truth[i] for i in truth)
    assert right >= 0.95 * len(truth)
    assert 1000 not in got and 1001 not in got and got[1002] == got[0]


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels, subjects = spark.createDataFrame([(1, "law")], "doc_id long, subject string"), spark.createDataFrame([("law",)], "subject string")
    assert rows(S.document_subjects(empty, labels, subjects)) == []
    assert rows(S.document_subjects(spark.createDataFrame([(1, "x")], "doc_id long, text string"), labels, subjects)) == []


def test_terms_of_sentences():
    parts = ["The Café menu, the café MENU!", "a b c", "", "Café menu 12 Straße", "x" * 5000 + " end"]
    terms, sentence = S.term_arrays(parts)
    words = [re.findall(r"[^\W\d_]+", p.casefold()) for p in parts]
    want = [len({w for w in ws if len(w) > 2} | set(zip(ws, ws[1:]))) for ws in words]
    assert np.bincount(sentence, minlength=len(parts)).tolist() == want
    of = [set(terms[sentence == i].tolist()) for i in range(len(parts))]
    assert len(of[0] & of[3]) == 3  # two words and their pair
    assert S.term_arrays([])[0].size == 0 and S.term_arrays(["1 2"])[0].size == 0


def test_bisecting_separates_groups():
    random.seed(3)
    groups = [[random.sample(range(g * 50, g * 50 + 20), 8) for _ in range(40)] for g in range(6)]
    dims = np.array([d for g in groups for doc in g for d in doc])
    tree = S.seed_tree(dims, np.full(240, 8), np.ones(S.DIMENSIONS), None, 1, 6, 1)
    leaf = tree.descend(np.zeros(240), *S._vectors(dims, np.full(240, 8), np.ones(S.DIMENSIONS), None)).reshape(6, 40)
    assert all(len(set(of)) == 1 for of in leaf.tolist()) and len(set(leaf[:, 0])) == 6
    same = S.seed_tree(np.tile([1, 2], 9), np.full(9, 2), np.ones(S.DIMENSIONS), None, 1, 6, 1)
    assert same.child == [0]  # equal vectors aren't divided


def test_leaves_with_two_subjects_have_two_parts():
    held, size = np.zeros((2, S.BUCKETS)), np.array([10.0, 10.0])
    held[0, :4], held[1, 4:6] = 9, 9
    told = np.zeros((3, S.BUCKETS))
    told[0, :2], told[1, 2:4], told[2, 4:6] = 9, 9, 9
    parts = S.leaf_parts(held, size, told, np.array([5.0, 5.0, 5.0]))
    assert (parts > 0).tolist() == [[True, True, False], [False, False, True]]
    share = S._shares(S.subject_counts(parts, held, told))
    mixed = S.mixture(parts, held, size, share, share >= 0.6)
    part = mixed.assign(np.array([0, 1, 2, 4, 7]), np.array([2, 1, 0, 1, 1]))
    assert [mixed.subject[p] if p >= 0 else None for p in part] == [0, 1, None, 2, None]


def test_every_document_takes_part_in_the_splits(spark, monkeypatch):
    random.seed(3)
    groups = [[random.sample(range(g * 50, g * 50 + 20), 8) for _ in range(40)] for g in range(6)]
    docs = spark.createDataFrame([(i, d) for i, d in enumerate(d for g in groups for d in g)], "doc_id long, words array<int>").repartition(3)
    monkeypatch.setattr(S, "SEEDS", 4, raising=False)  # a sample of so few would give no six leaves
    for local in (1 << 15, 60):  # one task splits the whole; passes split nodes of more than 60
        monkeypatch.setattr(S, "LOCAL", local)
        tree = S.grow(docs, lambda b: (np.zeros(len(b), dtype=np.int64), *S._lists(b.column("words"))), np.ones((1, S.DIMENSIONS)), 1, 6, 1)
        dims = np.array([d for g in groups for doc in g for d in doc])
        leaf = tree.descend(np.zeros(240), *S._vectors(dims, np.full(240, 8), np.ones(S.DIMENSIONS), None)).reshape(6, 40)
        assert all(len(set(of)) == 1 for of in leaf.tolist()) and len(set(leaf[:, 0])) == 6
    found = S.cluster(docs, 1, 6, 1)
    assert len(found.leaves.leaves()) == 6
