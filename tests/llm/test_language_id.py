import zlib

import numpy as np

from textloom.llm import language_id as L


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = {"t": rng.normal(0, 0.4, (2, 257, 9)), "u": rng.normal(0, 0.4, (2, 3, 9)), "wo": rng.normal(0, 0.4, (2, 3, 2)), "bo": np.zeros(2)}
    x = np.array([[5, 9, 7, 5, L.PAD], [9, 9, 5, 8, 7]])
    y = np.array([0, 1])

    def loss():
        m = L.Model(["a", "b"], *(p[n].copy() for n in ("t", "u", "wo", "bo")))
        m.t[:, L.PAD] = 0
        m.t[:, L.PAD, :3] = 1e4
        prob = L._probabilities(L.Model(m.langs, *(np.asarray(v, np.float64) for v in (m.t, m.u, m.wo, m.bo))), x.T.copy())
        return -sum(np.log(prob[y[i], s, i]) for i in range(2) for s in range(5) if x[i, s] != L.PAD) / 9

    g = L._gradients(p, x, y, 3)
    for name, at in (("u", (0, 1, 2)), ("u", (1, 2, 7)), ("wo", (0, 1, 1)), ("t", (0, 9, 4)), ("t", (1, 7, 8)), ("bo", (1,))):
        keep = p[name][at]
        p[name][at] = keep + 2e-2
        up = loss()
        p[name][at] = keep - 2e-2
        down = loss()
        p[name][at] = keep
        assert abs((up - down) / 4e-2 - g[name][at]) < 3e-3, name


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    out = L.op1_language_id(spark, sf_dir)
    assert out.count() == docs.count()
    right = out.join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").selectExpr("avg(cast(lang = lang_pred AS int)) AS a", "min(score) AS lo", "max(score) AS hi").first()
    assert right["a"] > 0.9 and 0 <= right["lo"] <= right["hi"] <= 1


def test_edges(spark, edge_docs, no_docs):
    model = L.train([("en", b"the and of with"), ("fr", "le été où les".encode())] * 20, steps=20)
    out = L.identify(edge_docs, model)
    assert out.count() == edge_docs.count()
    und = {r["doc_id"] for r in out.where("lang_pred = 'und'").collect()}
    assert und == {4, 5, 6, 10}
    assert L.identify(no_docs, model).count() == 0
    assert L.identify(edge_docs, L.fit(no_docs)).where("lang_pred <> 'und'").count() == 0
    assert L.keep_identified(edge_docs, model, 0.0).columns == edge_docs.columns


def test_long_text_does_not_depend_on_windows():
    model = L.train([("en", b"the and of with"), ("fr", "le été où les".encode())] * 20, steps=20)
    text = "the and of with " * 200
    alone, _ = L.pooled(model, [text])
    mixed, _ = L.pooled(model, ["le", text, None, "x" * 5000])
    assert np.allclose(alone[0], mixed[1], atol=1e-5) and abs(alone.sum() - 1) < 1e-4


def test_predictions_match_a_plain_forward_pass():
    """One byte at a time, one window after the other."""
    model = L.train([("en", b"the and of with"), ("fr", "le été où les".encode())] * 20, hidden=4, steps=30)
    hidden = model.u.shape[1]

    def states(raw, d):
        h, out = np.zeros(hidden), []
        for b in raw if d == 0 else raw[::-1]:
            a, u = model.t[d, b], h @ model.u[d]
            z, r = np.clip(0.25 * (a + u)[:hidden] + 0.5, 0, 1), np.clip(0.25 * (a + u)[hidden : 2 * hidden] + 0.5, 0, 1)
            c = a[2 * hidden :] + r * u[2 * hidden :]
            h = z * h + (1 - z) * c / (1 + np.abs(c))
            out.append(h)
        return out if d == 0 else out[::-1]

    for text in ("the été with les", "of", "où " * 300):
        raw, total = text.encode(), np.zeros(2)
        for s in range(0, len(raw), L.CORE):
            lo, hi = max(0, s - L.CONTEXT), min(len(raw), s + L.CORE + L.CONTEXT)
            f, b = states(raw[lo:hi], 0), states(raw[lo:hi], 1)
            for i in range(s - lo, min(s + L.CORE, len(raw)) - lo):
                e = np.exp(f[i] @ model.wo[0] + b[i] @ model.wo[1] + model.bo)
                total += e / e.sum()
        assert np.allclose(L.pooled(model, [text])[0][0], total / len(raw), atol=1e-4)


def test_text_in_no_language_goes_and_clean_texts_stay(spark, sf_dir):
    import random

    rng = random.Random(1)
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    model = L.fit(docs, noise=True)
    bound = L.noise_bound(docs, model)
    assert 0 <= bound < 1
    of = lambda letters, n, gap: ["".join(rng.choice(letters) + " " * (rng.random() < gap) for _ in range(n)) for _ in range(20)]
    for junk in (of("bcdfghjklmnpqrstvwxzäéñ", 2000, 0.2), of("abcdefghijklmnopqrstuvwxyz", 1000, 0.15), of("ABCDEFGHabcdefgh0123456789+/", 1500, 0), of("qzxwvk", 800, 0.1)):
        judged = spark.createDataFrame([(i, t) for i, t in enumerate(junk)], "doc_id long, text string")
        assert L.keep_identified(judged, model, bound).count() <= 1  # of 20
    lettered = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    assert L.keep_identified(docs, model, bound).where("lang IS NOT NULL").count() >= 0.995 * lettered.count()


def test_many_languages_are_all_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "DOCS", 40)
    rows = [(3 * i + j, f"l{i:03d}", f"text {chr(97 + i % 26) * 9} {i}") for i in range(60) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert {lang for lang, _ in L.training_windows(docs)} == {r[1] for r in rows}
    assert L.noise_bound(docs.where("1 = 0"), L.train([])) == L.TOWARDS


def test_bound_counts_every_document_whole(spark):
    """Few of many held-out documents are long and doubtful: neither a cap on length nor a sample may leave them out."""
    model = L.train([("en", b"the and of with")] * 20 + [(L.NOISE, b"qzxj kvqz jjxq")] * 20, steps=60)
    held = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 5 == 0]
    doubtful = {i for n, i in enumerate(held) if n % 125 == 0}  # 8 in 1,000, so the 99.5 % quantile is theirs
    rows = [(i, "qzxj kvqz jjxq " * 300 if i in doubtful else "the and of with", "en") for i in held]
    assert len(rows[0][1]) > 4_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    least = float(L.noise_margins(model, [rows[0][1]])[0])
    assert least > 0 and L.noise_bound(docs, model) >= least
    assert L.keep_identified(docs, model).count() == len(rows)
