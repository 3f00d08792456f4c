"""Gradients against differences, and training that learns."""

import numpy as np
import pytest

from cadenza.operators import training as tr


def differences(f, nets, at):
    flat = tr._flat(nets)
    out = []
    for i in at:
        both = []
        for d in (1e-6, -1e-6):
            x = flat.copy()
            x[i] += d
            both.append(f(tr._shaped(x, nets))[0])
        out.append((both[0] - both[1]) / 2e-6)
    return np.array(out)


def test_gradients():
    rng = np.random.default_rng(0)
    at = rng.integers(0, 60, 12)
    nets = [tr.layers((4, 5, 3), 1), tr.layers((4, 5, 3), 2)]
    f = lambda n: tr.tower_loss(n, x, y, z)
    x, y, z = rng.standard_normal((6, 4)), rng.standard_normal((6, 4)), rng.standard_normal((6, 3, 4))
    assert tr._flat(f(nets)[1])[at] == pytest.approx(differences(f, nets, at), rel=1e-3, abs=1e-4)
    nets = [tr.layers((8, 5, 1), 1), tr.layers((8, 5, 1), 2)]
    c, h = rng.standard_normal(4), rng.standard_normal((5, 4))
    g = lambda n: tr.click_loss(n, c, h, 1.0)
    assert tr._flat(g(nets)[1])[at] == pytest.approx(differences(g, nets, at), rel=1e-3, abs=1e-5)


def test_towers_learn(spark):
    rng = np.random.default_rng(1)
    turn = rng.standard_normal((4, 4))
    users = rng.standard_normal((200, 4))
    rows = [(u.tolist(), (u @ turn).tolist(), rng.standard_normal((5, 4)).tolist()) for u in users]
    df = spark.createDataFrame(rows, "user array<double>, item array<double>, others array<array<double>>").cache()
    nets, losses = tr.fit_towers(df, 4, epochs=25, hidden=(16, 8), rate=0.03)
    assert losses[-1] < 0.6 * losses[0]
    encoded = df.limit(3).select(tr.tower(nets[0])("user").alias("v")).collect()
    assert all(abs(np.linalg.norm(r.v) - 1) < 1e-6 for r in encoded)


def test_click_model_learns(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        c = rng.standard_normal(4)
        h = rng.standard_normal((4, 4))
        h[:, 0] += 2 if i % 2 else -2
        rows.append((c.tolist(), h.tolist(), i % 2))
    rows.append(([0.0] * 4, [], 1))
    df = spark.createDataFrame(rows, "candidate array<double>, history array<array<double>>, label int").cache()
    _, losses = tr.fit_din(df, 4, epochs=15, rate=0.03)
    assert losses[-1] < 0.5 * losses[0]


def test_steps_validation_and_going_on(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(c.tolist(), [[1.0, 0.0]], int(c[0] > 0)) for c in rng.standard_normal((120, 2))]
    df = spark.createDataFrame(rows, "candidate array<double>, history array<array<double>>, label int").cache()
    train, valid = df.where("candidate[1] > -1"), df.where("candidate[1] <= -1")
    whole, losses = tr.fit_din(train, 2, epochs=4, rate=0.05, steps=3, valid=valid)
    assert len(losses) == 4 and losses[-1] < losses[0]
    folder = f"{tmp_path}/state"
    tr.fit_din(train, 2, epochs=4, rate=0.05, steps=3, valid=valid, folder=folder)
    tr.save_weights(spark, tr.load_weights(spark, f"{folder}/epoch-2"), f"{tmp_path}/again/epoch-2")
    more, again = tr.fit_din(train, 2, epochs=4, rate=0.05, steps=3, valid=valid, folder=f"{tmp_path}/again")
    assert again == pytest.approx(losses)
    tr.save_weights(spark, tr.named([more.attention, more.click]), f"{tmp_path}/model")
    for net, want in zip(tr.unnamed(tr.load_weights(spark, f"{tmp_path}/model")), [whole.attention, whole.click], strict=True):
        assert all(np.allclose(a, b) for x, y in zip(net, want, strict=True) for a, b in zip(x, y, strict=True))


def test_ids_with_dictionaries_train_the_same_nets(spark, tmp_path, monkeypatch):
    """Each example carried its vectors; with ids and dictionaries of several chunks the nets are the same bit for bit;
    dealt in runs of a user they are the same but for the order of sums."""
    monkeypatch.setattr(tr, "TOGETHER", 3)
    monkeypatch.setattr(tr, "RUN", 8)
    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(40)], "song_id long, vec array<double>")
    users = spark.createDataFrame([(u, rng.standard_normal(4).tolist()) for u in range(30)], "user_id long, vec array<double>")
    plays = spark.createDataFrame([(u, int(s)) for u in range(32) for s in rng.integers(0, 44, 12)], "user_id long, song_id long")
    shown = spark.createDataFrame([(u, int(s)) for u in range(28) for s in set(rng.integers(0, 44, u % 5 + 1).tolist())], "user_id long, song_id long")
    key, nets = ["user_id", "song_id"], []
    whole = tr.with_vectors(plays, shown, users, vectors, 3)
    ids = tr.with_ids(plays, shown, users, vectors, 3)
    assert ids.count() == whole.count()
    chunks = tr.packed_ids(ids, tr.TOWER, key, {"user": users, "item": vectors, "others": vectors}, f"{tmp_path}/a", 16)
    assert chunks.selectExpr("sum(aggregate(counts, 0, (a, b) -> a + b))").first()[0] < 5 * whole.count() / 2  # vectors kept
    runs = tr.packed_ids(ids, tr.TOWER, key, {"user": users, "item": vectors, "others": vectors}, f"{tmp_path}/e", 16, runs=True)
    for x in (chunks, runs, runs.repartition(3), tr.packed(whole, tr.TOWER, key, f"{tmp_path}/b", 16)):
        nets.append(tr._flat(tr.fit_towers(x, 4, epochs=2, hidden=(6, 3))[0]))
    assert (nets[0] == nets[3]).all() and (nets[1] == nets[2]).all() and nets[0] == pytest.approx(nets[1], abs=1e-3)

    rows = [(u, int(rng.integers(0, 44)), u % 2, [int(x) for x in rng.integers(0, 44, 5)] + [None]) for u in range(90)] + [(95, 1, 0, [41, 42]), (96, 2, 1, [])]
    examples = spark.createDataFrame(rows, "user_id long, song_id long, label int, hist array<long>")
    whole, ids, nets = tr.with_histories(examples, vectors), tr.with_history_ids(examples, vectors), []
    assert ids.count() == whole.count()
    for x in (tr.packed_ids(ids, tr.CLICK, key, {"candidate": vectors, "history": vectors}, f"{tmp_path}/c", 8), tr.packed(whole, tr.CLICK, key, f"{tmp_path}/d", 8)):
        model, _ = tr.fit_din(x, 4, epochs=2)
        nets.append(tr._flat([model.attention, model.click]))
    assert (nets[0] == nets[1]).all()


def test_click_rates_send_a_vector_once_to_a_bucket(spark, monkeypatch):
    """Users who share their songs each had copies of the vectors in shuffles."""
    from cadenza.operators import ranking

    rng = np.random.default_rng(5)
    vec = {i: rng.standard_normal(3) for i in range(6)}
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in vec.items()], "song_id long, vec array<double>")
    hist = spark.createDataFrame([(u, (u + i) % 6, i) for u in range(50) for i in range(4)], "user_id long, song_id long, seq long")
    asked = spark.createDataFrame([(u, s) for u in range(50) for s in range(7)], "user_id long, song_id long")
    model = ranking.Din(3)
    df = ranking.click_rates(asked, hist, vectors, model)
    got = {(r.user_id, r.song_id): r.ctr for r in df.collect()}
    assert len(got) == 350 and all(got[u, 6] == 0.5 for u in range(50))
    for u in (0, 17, 49):
        h = np.stack([vec[(u + i) % 6] for i in range(4)])
        assert [got[u, s] for s in range(6)] == pytest.approx(model.rate(np.stack(list(vec.values())), h).tolist(), abs=1e-6)
    kept, = [f for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()} if "cadenza-asked" in f]
    assert {t for _, t in spark.read.parquet(kept).dtypes} == {"bigint", "array<bigint>"}  # ids only


def test_click_losses_are_sums_over_examples():
    """Each example was multiplied by itself, out of Python lists."""
    rng = np.random.default_rng(5)
    nets = [tr.layers((8, 5, 1), 1), tr.layers((8, 6, 1), 2)]
    size, label = np.array([3, 1, 4, 2]), np.array([1.0, 0.0, 0.0, 1.0])
    candidate, history = rng.standard_normal((4, 4)), rng.standard_normal((10, 4))
    loss, got = tr.click_losses(nets, candidate, history, size, label)
    ones = [tr.click_loss(nets, c, h, y) for c, h, y in zip(candidate, np.split(history, np.cumsum(size)[:-1]), label, strict=True)]
    assert loss == pytest.approx(sum(x for x, _ in ones))
    assert np.allclose(tr._flat(got), sum(tr._flat(g) for _, g in ones))
