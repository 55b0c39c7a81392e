import numpy as np

from lectern.llm.pages import STATES, TRAITS, Model, codes, fit, label_pages, traits

PROSE = "When the old miller had closed the shutters, it began to rain over the valley. Nobody in the house said a word."
VERSE = "O carry me over the river\nthe river that never was mine\n" * 6
CONTENTS = "\n".join(f"{i}. The {x} and the lost coat ..... {9 * i}" for i, x in enumerate(["miller", "doctor", "widow", "tailor", "postman"], 1))
SPEECH = "he said that the roof will not hold and then the doctor walked to the bridge in the dark with a lamp for the horses " * 3
LINKS = "\n".join(f"cheap coat » https://shop{i}.example/p/{i * 37}" for i in range(12))
TAGS = ", ".join(["best coat", "free download", "cheap lamp", "listen online", "best coat", "mp3"] * 10)
STUFFED = "torrent online torrent best torrent free torrent review " * 12
OFFERS = "\n".join(f"Coat XZ-{i} | {i}.99 | add to cart" for i in range(12))
CHINESE = "自从译者还了图书馆的书以后，那个村子里没有人再见过他。磨坊主在火边睡着了的时候，医生已经在机车库了。"
HAN_TAGS = "电子书无弹窗电子书优惠券无弹窗优惠券优惠券电子书" * 8


def test_kinds(spark):
    spam = [LINKS, TAGS, STUFFED, OFFERS, HAN_TAGS, LINKS + "\n" + PROSE]
    fine = [PROSE, VERSE, CONTENTS, SPEECH, CHINESE, PROSE * 8 + "\nSee also:\nhttps://a.example/p/1\nhttps://b.example/p/2", "one", "Chapter 3"]
    none = [None, "", " \n\t", "\u200b"]
    rows = [(i, t, "x") for i, t in enumerate(spam + fine * 4 + none + spam[:1])]
    out = {r.doc_id: r for r in label_pages(spark.createDataFrame(rows, "doc_id bigint, text string, links string"), "doc_id", "text").collect()}
    assert len(out) == len(rows)
    assert sorted(k for k, r in out.items() if r.nonprose > 0.5) == [0, 1, 2, 3, 4, 5, len(rows) - 1]
    assert all(out[i].visible == 0 and out[i].nonprose == 0 for i in range(len(rows) - 5, len(rows) - 1))
    assert label_pages(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def test_addresses_of_any_domain(spark):
    kinds = ["com", "de", "co.uk", "museum", "xn--p1ai"]
    rows = [(k, "\n".join(f"shop{i}-{k}.{d}" for i in range(60))) for k, d in enumerate(kinds)] + [(9, PROSE + " At 3.15 p.m. e.g. Mr.Cole left No.7."), (10, PROSE)]
    out = {r.i: r.nonprose for r in label_pages(spark.createDataFrame(rows, "i int, t string"), "i", "t").collect()}
    assert all(out[k] == 1 for k in range(len(kinds))) and out[9] == out[10] == 0
    assert traits("see shop.de and a.m. or 3.15 then.")[0] > 0 and traits("He left.Then it rained at 3.15 p.m. in U.K.")[0] <= 1


def test_the_fit_leaves_the_first_guess(spark):
    """Link lists that set prices in every line: the model learns it, start and moves with it, and the size is no matter."""
    priced = "\n".join(f"shop{i}.de | {i}.99" for i in range(30))
    models = []
    for n in (40, 160):
        rows = [(codes(priced)[0],) for _ in range(n)] + [(codes(PROSE)[0],) for _ in range(n)]
        models.append(fit(spark.createDataFrame(rows, "codes array<int>")))
    first = Model.first()
    price, links = list(TRAITS).index("price"), STATES.index("links")
    assert first.traits[price][links][1] < 0.05 and all(m.traits[price][links][1] > 0.5 for m in models)
    assert all(m.start[links] > 0.19 > first.start[links] for m in models) and abs(models[0].traits[price] - models[1].traits[price]).max() < 0.1


def test_best_path_against_all_paths():
    import itertools

    m = Model.first()
    r = np.random.default_rng(1)
    rows = [r.integers(0, m.emit.shape[1], n) for n in (1, 2, 4, 5)]
    for row, got in zip(rows, m.best(rows)):
        score = lambda p: np.log(m.start[p[0]]) + sum(m.emit[s, c] for s, c in zip(p, row)) + sum(np.log(m.move[a, b]) for a, b in zip(p, p[1:]))
        assert abs(max(map(score, itertools.product(range(4), repeat=len(row)))) - score(got)) < 1e-9
    g, moves = m.posterior(rows)
    paths = list(itertools.product(range(4), repeat=4))
    weight = np.array([m.start[p[0]] * np.exp(sum(m.emit[s, c] for s, c in zip(p, rows[2]))) * np.prod([m.move[a, b] for a, b in zip(p, p[1:])]) for p in paths])
    want = np.array([[weight[[q[t] == s for q in paths]].sum() for s in range(4)] for t in range(4)]) / weight.sum()
    assert np.allclose(g[2], want) and np.isclose(moves.sum(), 1 + 3 + 4)
