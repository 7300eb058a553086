"""Numeric kernels against known values and slow definitions."""

import numpy as np

from orebed.operators import kernels as K
from orebed.operators import selection as S
from orebed.streaming import online as O


def test_welch_finds_a_tone():
    x = np.sin(2 * np.pi * 50 * np.arange(2048) / 1000)
    f, p = K.welch(x, 1000.0)
    assert abs(f[p.argmax()] - 50) < 4
    assert abs(p.sum() * (f[1] - f[0]) - 0.5) < 0.02


def test_peaks_take_the_middle_of_level_tops():
    assert K.peaks(np.array([0, 2, 2, 2, 1, 3, 0.0, 1, 1])).tolist() == [2, 5]


def test_bandpass_keeps_its_band():
    t = np.arange(4000) / 1000
    x = np.sin(2 * np.pi * 50 * t) + np.sin(2 * np.pi * 200 * t)
    y = K.bandpass(x, 1000.0, 150.0, 250.0)
    assert np.abs(y - np.sin(2 * np.pi * 200 * t))[500:-500].max() < 0.05


def slow_transform(x, sign=-1):
    n = len(x)
    return np.array([sum(v * np.exp(sign * 2j * np.pi * j * k / n) for j, v in enumerate(x)) for k in range(n)])


def test_bandpass_by_its_definition():
    """Ends mirrored about their values, a plain Fourier sum, the squared gain of the bilinear Butterworth band-pass, and back."""
    x = np.random.default_rng(3).standard_normal(40).cumsum()
    pad, n = 27, 40 + 54
    y = [2 * x[0] - x[pad - i] for i in range(pad)] + list(x) + [2 * x[-1] - x[-2 - i] for i in range(pad)]
    s = slow_transform(y)
    low, high = np.tan(np.pi * 0.05), np.tan(np.pi * 0.2)
    for k in range(n):
        f = min(k, n - k) / n
        w = np.tan(np.pi * min(f, 0.5 * (1 - 1e-9)))
        s[k] *= 0 if f == 0 else 1 / (1 + ((w * w - low * high) / (w * (high - low))) ** 8)
    assert np.allclose(K.bandpass(x, 1.0, 0.05, 0.2), (slow_transform(s, 1) / n).real[pad : pad + 40], atol=1e-8)


def test_envelope_spectrum_by_its_definition():
    x = np.random.default_rng(4).standard_normal(31)
    c = x - x.mean()
    s = slow_transform(c)
    analytic = slow_transform([v * (1 if k == 0 else 2 if k <= 15 else 0) for k, v in enumerate(s)], 1) / 31
    e = np.abs(analytic)
    e = (e - e.mean()) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(31) / 30))
    f, p = K.envelope_spectrum(x, 1.0)
    assert np.allclose(f, np.arange(16) / 31)
    assert np.allclose(p, np.abs(slow_transform(e))[:16] ** 2)


def test_canonical_variates_by_eigenvalues():
    """Scores don't depend on how the variates are turned: they come from the past blocks' covariance and what it shares with the future's."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((80, 2)).cumsum(axis=0) * 0.3 + rng.standard_normal((80, 2))
    z = (x - x[:50].mean(axis=0)) / x[:50].std(axis=0)
    rows = range(2, 48)
    p, f = np.array([z[i - 2 : i].ravel() for i in rows]), np.array([z[i : i + 2].ravel() for i in rows])
    mean = p.mean(axis=0)
    pp, ff, pf = np.cov(p.T, bias=True) + 1e-6 * np.eye(4), np.cov(f.T, bias=True) + 1e-6 * np.eye(4), (p - mean).T @ (f - f.mean(axis=0)) / len(p)
    v, u = np.linalg.eigh(pp)
    white = u @ np.diag(v**-0.5) @ u.T
    _, vectors = np.linalg.eigh(white @ pf @ np.linalg.inv(ff) @ pf.T @ white)
    share = vectors[:, -2:] @ vectors[:, -2:].T
    slow = [(z[i - 2 : i].ravel() - mean) @ white @ share @ white @ (z[i - 2 : i].ravel() - mean) for i in range(2, 80)]
    t2, alarm = K.cva_monitor(x, 50, 2, 2, 0.9)
    assert np.allclose(t2[2:], slow)
    assert alarm[2:].tolist() == (np.array(slow) > np.quantile(slow[:48], 0.9)).tolist()


def test_wavelet_is_exact_without_noise():
    assert np.allclose(K.wavelet_denoise(np.zeros(64)), 0)
    assert np.allclose(K.wavelet_denoise(np.full(64, 3.0)), 3.0)


def test_f_tail():
    assert abs(K.f_tail(4.964602743730711, 1, 10) - 0.05) < 1e-6
    assert abs(K.f_tail(1.0, 5, 5) - 0.5) < 1e-9


def test_granger_sees_the_direction():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(300)
    y = np.concatenate([[0], 0.9 * x[:-1]]) + 0.1 * rng.standard_normal(300)
    assert K.granger(x, y, 2) < 1e-6 < K.granger(y, x, 2)


def test_change_points():
    assert [i for i, _ in K.change_points(np.r_[np.zeros(30), np.full(30, 9.0)] + 0.1 * np.sin(np.arange(60)), 5, 3.0)] == [30]


def test_cva_alarms_on_a_shift():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 3))
    x[250:] += 8
    _, alarm = K.cva_monitor(x, 200, 2, 3)
    assert alarm[255:].mean() > 0.9
    assert alarm[:200].mean() < 0.05


def test_moments(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 3))
    n, mean, cov = K.moments(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>"), "v")
    assert n == 500
    assert np.allclose(mean, x.mean(axis=0))
    assert np.allclose(cov, np.cov(x.T))


def test_phasor_of_a_cosine(spark):
    rows = spark.createDataFrame([(1, i, 3 * float(np.cos(2 * np.pi * 2 * i / 40 + 0.5))) for i in range(40)], "k int, i int, v double")
    got = S.phasor(["k"], "v", "i", 2.0, rows).first()
    assert np.allclose([got.re, got.im], [3 * np.cos(0.5), 3 * np.sin(0.5)])


def test_state_survives_between_batches(spark, tmp_path):
    """Two files read one by one give what the kernel gives on the whole series."""
    values = [0.0, 3.0, 4.0, 0.0, 5.0, 6.0, -9.0, -9.0]
    for part in range(2):
        spark.createDataFrame([(1, i, values[i]) for i in range(4 * part, 4 * part + 4)], "k long, i long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, i long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = O.drained(O.online_cusum(stream, "k", ["i"], "v", 0.0, 1.0)).orderBy("i").collect()
    pos, neg, alarm = K.cusum(np.array(values), 0.5, 5.0)
    assert [(r.pos, r.neg, r.alarm) for r in got] == list(zip(pos.tolist(), neg.tolist(), alarm.tolist(), strict=True))


def test_change_points_by_a_slow_search():
    """Again and again the strongest contrast that is far enough from those chosen."""
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.standard_normal(120)) + np.repeat([0, 9, -4, 6], 30)
    size, least = 5, 2.0
    score = {}
    for i in range(size, len(x) - size + 1):
        a, b = x[i - size : i], x[i : i + size]
        both = np.r_[a - np.median(a), b - np.median(b)]
        mad = 1.4826 * np.median(np.abs(both))
        score[i] = abs(np.median(b) - np.median(a)) / (mad if mad > 1e-12 else max(both.std(), 1e-12))
    chosen = []
    while score and max(score.values()) >= least:
        best = min(i for i in score if score[i] == max(score.values()))
        chosen.append((best, float(score[best])))
        score = {i: s for i, s in score.items() if abs(i - best) >= size}
    assert K.change_points(x, size, least) == sorted(chosen)


def test_granger_by_plain_regression():
    """The F statistic from normal equations, its p-value from simulated F draws."""
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal(60), rng.standard_normal(60)
    y[1:] += 0.25 * x[:-1]
    target, own, both = y[1:], np.c_[np.ones(59), y[:-1]], np.c_[np.ones(59), y[:-1], x[:-1]]
    rss = [target @ target - target @ m @ np.linalg.solve(m.T @ m, m.T @ target) for m in (own, both)]
    f = (rss[0] - rss[1]) / (rss[1] / 56)
    draws = rng.chisquare(1, 400_000) / (rng.chisquare(56, 400_000) / 56)
    assert abs(K.granger(x, y, 1) - (draws > f).mean()) < 0.003


def test_spectral_kurtosis_by_definition():
    rng = np.random.default_rng(6)
    x = rng.standard_normal(256)
    got = K.spectral_kurtosis(x, 8)
    assert got.shape == (5,)
    burst = x.copy()
    burst[100:108] += 30 * np.cos(np.pi * np.arange(8) / 2)
    assert K.spectral_kurtosis(burst, 8)[2] > got[2] + 2


def test_hash_embedding_by_hand():
    import hashlib

    text, dim = "Pump 12 pump-12 ok", 16
    words = ["pump", "12", "pump", "12", "ok"]
    want = [0.0] * dim
    for w in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
        d = hashlib.blake2b(w.encode(), digest_size=8).digest()
        want[int.from_bytes(d[:4], "little") % dim] += 1 if d[4] % 2 else -1
    norm = sum(v * v for v in want) ** 0.5
    assert np.allclose(K.hash_embedding(text, dim), [v / norm for v in want])
    assert K.hash_embedding(None, dim) == [0.0] * dim


def test_packed_chunks_hold_the_text():
    """Chunks keep to the budget and their places; together they hold every paragraph in order."""
    rng = np.random.default_rng(7)
    for _ in range(50):
        text = "\n".join("x" * int(n) + "y" for n in rng.integers(0, 60, 12))
        chunks = K.packed_chunks(text, 40)
        assert [c[0] for c in chunks] == list(range(len(chunks)))
        assert all(len(c[3]) <= 40 and c[2] - c[1] == len(c[3]) for c in chunks)
        assert "".join(c[3] for c in chunks).replace("\n", "") == text.replace("\n", "")
        assert all(text[s:e].replace("\n", "") == c.replace("\n", "") for _, s, e, c in chunks)


def test_pca_monitor_by_svd(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((200, 4)) @ np.diag([5.0, 2.0, 0.5, 0.1])
    x[190:] += [0, 0, 6, 6]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r.id: r for r in K.pca_monitor(table, table.where("id < 150"), "id", "v", variance=0.9).collect()}
    ref = x[:150]
    _, s, vt = np.linalg.svd(ref - ref.mean(axis=0), full_matrices=False)
    share = np.cumsum(s**2) / (s**2).sum()
    k = int((share < 0.9).sum()) + 1
    t = (x - ref.mean(axis=0)) @ vt[:k].T
    spe, t2 = (((x - ref.mean(axis=0)) - t @ vt[:k]) ** 2).sum(axis=1), (t**2 / (s[:k] ** 2 / 149)).sum(axis=1)
    assert np.allclose([got[i].spe for i in range(200)], spe)
    assert np.allclose([got[i].t2 for i in range(200)], t2)
    alarm = (spe > np.quantile(spe[:150], 0.99)) | (t2 > np.quantile(t2[:150], 0.99))
    assert [got[i].alarm for i in range(200)] == alarm.tolist()
