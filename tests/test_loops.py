"""Operators held against plain loops that follow the rules step by step, on generated input."""

import heapq
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from framelake.functions import columns as C
from framelake.operators import aggregates as A
from framelake.operators import joins as J
from framelake.operators import rate_model
from framelake.operators import windows as W

R = random.Random(7)


def test_rescale_ts(spark):
    values = [None, 0, 1, -1, 89, 90, 91, -90, -91, 2**62, -(2**62)] + [R.randint(-(10**12), 10**12) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", C.rescale_ts(F.col("v"), (1, 90), (1, 48)).alias("near"), C.rescale_ts(F.col("v"), (1, 90), (1, 48), "up").alias("up"))
    for v, near, up in df.collect():
        if v is None:
            assert near is None and up is None
            continue
        p = v * 48
        assert near == (1 if p >= 0 else -1) * ((2 * abs(p) + 90) // 180)
        assert up == -((-p) // 90)


def payloads():
    out = []
    for _ in range(200):
        b = bytearray()
        for _ in range(R.randint(0, 30)):
            c = R.choice([0, 1, 3, 200])
            if not (c == 0 and b[-2:] == b"\0\0"):
                b.append(c)
        out.append(bytes(b))
    return out


def loop_strip(p):
    out, zeros = bytearray(), 0
    for b in p:
        if zeros == 2 and b == 3:
            zeros = 0
            continue
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def loop_insert(p):
    out, zeros = bytearray(), 0
    for b in p:
        if zeros == 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def loop_bits(p):
    p = p.rstrip(b"\0")
    return 8 * len(p) - ((p[-1] & -p[-1]).bit_length() - 1) - 1 if p else 0


def test_emulation_and_bits(spark):
    df = spark.createDataFrame([(p,) for p in payloads()], "p binary")
    for p, s, i, n in df.select("p", C.strip_emulation(F.col("p")), C.insert_emulation(F.col("p")), C.payload_bits(F.col("p"))).collect():
        assert bytes(s) == loop_strip(bytes(p))
        assert bytes(i) == loop_insert(bytes(p))
        assert n == loop_bits(bytes(p))
        assert loop_strip(loop_insert(bytes(p))) == bytes(p)


def golomb(v):
    bits = bin(v + 1)[2:]
    return "0" * (len(bits) - 1) + bits


def test_slice_lead_fields(spark):
    rows = []
    for _ in range(100):
        f = (R.randint(0, 400), R.randint(0, 9), R.randint(0, 255))
        bits = "".join(map(golomb, f)) + "1"
        bits += "0" * (-len(bits) % 8)
        rows.append((*f, bytes([0x65]) + int(bits, 2).to_bytes(len(bits) // 8, "big")))
    df = spark.createDataFrame(rows, "a long, b long, c long, p binary")
    for a, b, c, _, s in df.withColumn("s", C.slice_lead_fields(F.col("p"))).collect():
        assert tuple(s) == (a, b % 5, c)


@pytest.mark.parametrize("layout", C.RTP_LAYOUTS)
def test_rtp_header_fields(spark, layout):
    rows = []
    for _ in range(50):
        v, p, x, cc, m, pt = R.choice([(2, 0, 0, 0), (1, 0, 0, 0), (2, 1, 0, 0), (2, 0, 1, 3)]) + (R.randint(0, 1), R.randint(0, 127))
        seq, ts, ssrc = R.randint(0, 65535), R.randint(0, 2**32 - 1), R.randint(0, 2**32 - 1)
        if layout == "low_first":
            head = bytes([v | p << 2 | x << 3 | cc << 4, m | pt << 1]) + struct.pack("<HII", seq, ts, ssrc)
        else:
            head = bytes([v << 6 | p << 5 | x << 4 | cc, m << 7 | pt]) + struct.pack(">HII", seq, ts, ssrc)
        rows.append((head + b"abc", [v, p, x, cc, m, pt, seq, ts, ssrc]))
    rows.append((b"\x80\0", None))
    df = spark.createDataFrame(rows, "d binary, w array<long>").withColumn("h", C.rtp_header_fields(F.col("d"), layout))
    for _, want, h, ok in df.withColumn("ok", C.rtp_valid(F.col("d"), F.col("h"))).collect():
        if want is None:
            assert not ok
            continue
        assert [h[k] for k in range(9)] == want and bytes(h["payload"]) == b"abc"
        assert ok == (want[:4] == [2, 0, 0, 0])


def test_poc_type0_loop(spark):
    rows, want = [], {}
    for s in range(10):
        msb = lsb = poc = 0
        gop = 0
        for i in range(80):
            idr, ref = i == 0 or R.random() < 0.03, R.random() < 0.6
            gop += idr
            poc = 0 if idr else poc + R.randint(-3, 6)
            low = poc % 16
            if idr:
                msb = lsb = 0
                ref = True
            here = msb + 16 if low < lsb and lsb - low >= 8 else msb - 16 if low > lsb and low - lsb > 8 else msb
            want[s, i] = here + low
            if ref:
                msb, lsb = here, low
            rows.append((s, gop, i, int(idr), int(ref), low))
    df = spark.createDataFrame(rows, "stream_id long, gop long, i long, idr int, is_ref int, poc_lsb long")
    assert {(r.stream_id, r.i): r.poc for r in W.poc_type0(df, 16).collect()} == want


def loop_bucket(bits, rate):
    """Bucket and start level by simulation from the closed form's definition of need."""
    s = [i * rate - sum(bits[: i + 1]) + bits[i] for i in range(len(bits))]
    need = [max(s[: i + 1]) - s[i] + bits[i] for i in range(len(bits))]
    size = max(need)
    least = None
    for start in range(size + 1):  # a start level works if a saturating bucket never runs dry
        level, ok = start, True
        for b in bits:
            if b > level:
                ok = False
                break
            level = min(level - b + rate, size)
        if ok:
            least = start
            break
    return size, least


def test_leaky_bucket_never_underflows(spark):
    logs = {s: [R.randint(1, 60) for _ in range(30)] for s in range(25)}
    frames = spark.createDataFrame([(s, i, b) for s, bits in logs.items() for i, b in enumerate(bits)], "stream_id long, i long, bits long")
    rates = spark.createDataFrame([(s, r) for s in logs for r in (20, 30, 45)], "stream_id long, rate long")
    for r in W.leaky_bucket(frames, rates).collect():
        size, start = loop_bucket(logs[r.stream_id], r.rate)
        assert r.b == size
        level = r.f
        assert level >= start
        for b in logs[r.stream_id]:
            assert b <= level
            level = min(level - b + r.rate, r.b)


def loop_mux(video, audio):
    out, v, a, vt, at = [], 0, 0, 0, 0
    while True:
        if vt <= at:
            if v == len(video):
                return out
            out.append((0, v))
            vt = max(vt, video[v])
            v += 1
        else:
            if a == len(audio):
                return out
            out.append((1, a))
            at = max(at, audio[a])
            a += 1


def test_mux_interleave_loop(spark):
    files = {f: ([R.randint(0, 20) for _ in range(R.randint(1, 8))], [R.randint(0, 20) for _ in range(R.randint(1, 8))]) for f in range(60)}
    side = lambda k: spark.createDataFrame([(f, p, t) for f, both in files.items() for p, t in enumerate(both[k])], "file long, pos long, pts long")
    got = {}
    for r in J.mux_interleave(side(0), side(1)).orderBy("file", "n").collect():
        got.setdefault(r.file, []).append((r.kind, r.pos))
    assert got == {f: w for f, both in files.items() if (w := loop_mux(*both))}


def loop_pairs(structures):
    out, held = [], None
    for i, s in enumerate(structures):
        if s == "F":
            out += [(held[0], held[1])] if held else []
            out.append((i, s))
            held = None
        elif held and held[1] != s:
            out.append((held[0], held[1] + s))
            held = None
        else:
            out += [(held[0], held[1])] if held else []
            held = (i, s)
    return out + ([(held[0], held[1])] if held else [])


def test_pair_fields_loop(spark):
    streams = {s: [R.choice("TBF") for _ in range(R.randint(1, 15))] for s in range(100)}
    df = spark.createDataFrame([(s, i, x) for s, xs in streams.items() for i, x in enumerate(xs)], "stream_id long, i long, structure string")
    got = {}
    for r in W.pair_fields(df).orderBy("stream_id", "i").collect():
        got.setdefault(r.stream_id, []).append((r.i, r.structure))
    assert got == {s: sorted(loop_pairs(xs)) for s, xs in streams.items()}


def test_access_units_loop(spark):
    files = {f: [R.choice([1, 5, 6, 7, 8, 9, 13, 14, 18, 12]) for _ in range(20)] for f in range(30)}
    df = spark.createDataFrame([(f, p, t) for f, ts in files.items() for p, t in enumerate(ts)], "file long, pos long, nal_type int")
    got = {(r.file, r.pos): (r.au, r.au_position) for r in W.access_units(df).collect()}
    for f, ts in files.items():
        picture, au, n = False, 1, 0
        for p, t in enumerate(ts):
            if t in (6, 7, 8, 9) or 13 <= t <= 18:
                if picture:
                    picture, au, n = False, au + 1, 0
            n += 1
            if 1 <= t <= 5:
                picture = True
            assert got[f, p] == (au, n)


def test_complexity_ema_and_packing(spark):
    values = [R.random() * 100 for _ in range(20)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "stream_id long, i long, complexity double")
    w = 0.0
    got = {r.i: r.weight for r in W.complexity_ema(df).collect()}
    for n, a in enumerate(values, 1):
        w = a if n == 1 else a * (n - 1) / n + w / n if n < 8 else a / 8 + w * 7 / 8  # the newest frame's weight is the first term
        assert math.isclose(got[n - 1], w)
    sizes = [R.randint(1, 50) for _ in range(60)]
    packed = W.pack_by_bytes(spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "stream_id long, pos long, size long"), 60)
    group, fill = -1, 61
    want = []
    for s in sizes:
        if fill + s > 60:
            group, fill = group + 1, 0
        fill += s
        want.append(group)
    assert [r.group for r in packed.orderBy("pos").collect()] == want


def test_rolling_rate_model(spark):
    exact = [(q, 5000 / q + 900 / (q * q)) for q in (1.0, 2.0, 3.0, 4.0, 6.0)]
    x1, x2 = rate_model.estimate(exact)
    assert math.isclose(x1, 5000) and math.isclose(x2, 900)
    assert rate_model.estimate([(2.0, 10.0), (2.0, 20.0)]) == (30.0, 0.0)
    frames = [(q, r * 2, 2.0) for q, r in exact * 5]
    state, windows = rate_model.START, []
    for f in frames:
        state, (w, _, _) = rate_model.next_model(state, f)
        windows.append(w)
    assert windows == [min(k, 20) for k in range(1, 26)]
    df = spark.createDataFrame([(s, i, *f) for s in (1, 2) for i, f in enumerate(frames)], "stream_id long, i long, q double, bits double, mad double")
    rows = rate_model.rolling_rate_model(df).where("i >= 5").collect()
    assert rows and all(math.isclose(r.x1, 5000, rel_tol=1e-6) for r in rows)


def test_gop_initial_qp_loop(spark):
    gops = [(1, g, R.randint(0, 5), R.randint(0, 8)) for g in range(1, 30)]
    rows = [(s, g, np_, nb, sum(qs), qs[-1] if qs else 26) for s, g, np_, nb in gops for qs in [[R.randint(10, 50) for _ in range(np_)]]]
    got = {r.gop: r.qp for r in A.gop_initial_qp(spark.createDataFrame(rows, "stream_id long, gop long, np long, nb long, sum_qp long, last_qp int"), 30).collect()}
    qp = 30
    for _, g, n, nb, total, last in rows:
        assert got[g] == qp
        if n:
            average = int(total / n + 0.5) - min(2, int(0.5 + (n + nb + 1) / 15))
            average -= average > last - 2
            qp = max(0, min(51, max(qp - 2, min(qp + 2, average))))


def test_prefix_code_is_optimal(spark):
    counts = {"a": 45, "b": 13, "c": 12, "d": 16, "e": 9, "f": 5}
    lengths = {r.sym: r.length for r in A.prefix_code_lengths(spark.createDataFrame([(1, s, n) for s, n in counts.items()], "doc_id long, sym string, n long")).collect()}
    heap, cost = list(counts.values()), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert sum(counts[s] * n for s, n in lengths.items()) == cost
    assert sum(2.0**-n for n in lengths.values()) == 1


def test_interleaved_group_and_ssim(spark):
    df = spark.range(24).select(J.interleaved_group(F.col("id"), [2, 3, 1]).alias("g")).collect()
    assert [r.g for r in df] == [0, 0, 1, 1, 1, 2] * 4
    px = spark.createDataFrame([(0, x, y, (x * 31 + y * 17) % 256) for x in range(16) for y in range(16)], "frame_no long, x long, y long, v int")
    assert A.ssim(px, px).first().ssim == 1.0
    assert A.pixel_errors(px, px, ["frame_no"]).first().psnr is None


@pytest.mark.parametrize("segment", [1, 3, 4096])
def test_segments_of_frames(spark, segment):
    rows = [(f, x, 0, R.randint(0, 255), R.choice([1, 1, 3]), int(R.random() < 0.2)) for f in range(40) if f % 7 for x in range(3)]
    df = spark.createDataFrame(rows, "frame_no long, x long, y long, v int, state int, refreshed int")
    copied = {(r.frame_no, r.x): r.concealed for r in W.conceal_by_copy(df, segment=segment).collect()}
    ages = {(r.frame_no, r.x): r.age for r in W.refresh_age(df, 9, segment=segment).collect()}
    for x in range(3):
        last, age = None, 0
        for f, _, _, v, state, refreshed in [r for r in rows if r[1] == x]:
            last = v if state > 1 else last
            age = 1 if refreshed else age + 1
            assert copied[f, x] == last and ages[f, x] == min(age, 9)
    assert len(copied) == len(ages) == len(rows)


def test_folds_go_on_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(s, i, R.randint(1, 50)) for s in range(5) for i in range(60)]
        R.shuffle(rows)
        got = W.pack_by_bytes(spark.createDataFrame(rows, "stream_id long, pos long, size long").repartition(3), 60).collect()
        assert len(got) == 300 and all(sum(r.size for r in got if (r.stream_id, r.group) == key) <= 60 for key in {(r.stream_id, r.group) for r in got})
        assert max(r.group for r in got) < 60
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("segment", [1, 7, 1 << 16])
def test_running_sums_in_segments(spark, segment):
    rows = [(s, i, R.randint(1, 90)) for s in range(3) for i in range(50) if R.random() < 0.8]
    df = spark.createDataFrame(rows, "stream_id long, i long, bits long").repartition(3)
    got = {(r.stream_id, r.i): r.fullness for r in W.buffer_fullness(df, 300, 30, segment=segment).collect()}
    for s in range(3):
        level = 0.0
        for _, i, bits in [r for r in rows if r[0] == s]:
            level += bits - 10
            assert math.isclose(got[s, i], level)
    assert len(got) == len(rows)


def loop_levels(bits, rate, size):
    level, out = 0, []
    for b in bits:
        full = max(level - rate, 0) + b
        out.append((min(full, size), "overflow" if full > size else "underflow" if level < rate else None))
        level = min(full, size)
    return out


@pytest.mark.parametrize("segment", [1, 16, 1 << 16])
def test_composed_segments(spark, segment):
    """Rules that are sequential by nature, in segments: one stream holds a third of all rows."""
    logs = {s: [R.choice([R.randint(1, 60), R.randint(1, 9)]) for _ in range(200 if s == 0 else 25)] for s in range(17)}
    df = spark.createDataFrame([(s, i, b) for s, bits in logs.items() for i, b in enumerate(bits)], "stream_id long, i long, bits long").repartition(4)
    levels = {(r.stream_id, r.i): (r.level, r.alert) for r in W.bucket_levels(df, 20, 55, segment=segment).collect()}
    weights = {(r.stream_id, r.i): r.weight for r in W.complexity_ema(df.withColumn("complexity", F.col("bits") / 10), segment=segment).collect()}
    groups = {(r.stream_id, r.i): (r.bits, r.group) for r in W.pack_by_bytes(df, 50, order="i", size="bits", segment=segment).collect()}
    assert len(levels) == len(weights) == len(groups) == sum(map(len, logs.values()))
    for s, bits in logs.items():
        assert [levels[s, i] for i in range(len(bits))] == loop_levels(bits, 20, 55)
        w, group, fill = 0.0, -1, 51
        for i, b in enumerate(bits):
            n, a = i + 1, b / 10
            w = a if n == 1 else a * (n - 1) / n + w / n if n < 8 else a / 8 + w * 7 / 8
            group, fill = (group + 1, b) if group < 0 or fill + b > 50 else (group, fill + b)
            assert math.isclose(weights[s, i], w) and groups[s, i] == (b, group)


@pytest.mark.parametrize("segment", [1, 4, 16, 1 << 16])
def test_leaky_bucket_in_segments(spark, segment):
    logs = {s: [R.randint(1, 60) for _ in range(150 if s == 0 else 30)] for s in range(11)}
    df = spark.createDataFrame([(s, i, b) for s, bits in logs.items() for i, b in enumerate(bits)], "stream_id long, i long, bits long").repartition(3)
    rates = spark.createDataFrame([(s, r) for s in logs for r in (20, 31, 45)], "stream_id long, rate long")
    got = {(r.stream_id, r.rate): (r.b, r.f) for r in W.leaky_bucket(df, rates, segment=segment).collect()}
    for (s, rate), found in got.items():
        need, low, levels, sums = [], [], [], 0
        for n, b in enumerate(logs[s]):
            sums += b
            need.append((n * rate - sums + b, b))
            low.append(sums - n * rate)
            levels.append(logs[s][0] - low[-1] + max(0, max(low) - logs[s][0]))
        needs = [max(x for x, _ in need[: n + 1]) - x + b for n, (x, b) in enumerate(need)]
        size = max(needs)
        until = min([needs.index(size)] + [n for n, y in enumerate(levels) if y + rate > size][:1])
        assert found == (size, max(logs[s][0], *low[: until + 1])), (s, rate)
    assert len(got) == 33


@pytest.mark.parametrize("segment", [1, 5])
def test_gop_quantisers_in_segments(spark, segment):
    rows = [(s, g, n, R.randint(0, 8), sum(qs), qs[-1] if qs else 26) for s in range(3) for g in range(1, 40) for n in [R.randint(0, 5)] for qs in [[R.randint(0, 51) for _ in range(n)]]]
    df = spark.createDataFrame(rows, "stream_id long, gop long, np long, nb long, sum_qp long, last_qp int")
    assert {tuple(r) for r in A.gop_initial_qp(df, 60, 3, 48, segment=segment).collect()} == {tuple(r) for r in A.gop_initial_qp(df, 60, 3, 48).collect()}


def test_packing_one_long_stream(spark):
    """A million units of one stream, in 62 segments that are packed side by side."""
    n, cap = 1_000_000, 12000
    sizes = F.pmod(F.xxhash64("id"), F.lit(1500)) + F.when(F.col("id") % 9973 == 0, 20000).otherwise(1)
    units = spark.range(n).select(F.lit(1).cast("long").alias("stream_id"), F.col("id").alias("pos"), sizes.alias("size"))
    packed = W.pack_by_bytes(units, cap, segment=1 << 14)
    found = packed.groupBy("group").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.sum("size").alias("s"), F.min_by("size", "pos").alias("head")).orderBy("group").collect()
    greedy, fill = [0], 0
    for i, (s,) in enumerate(units.select("size").toPandas().itertuples(index=False)):
        if i and fill + s > cap:
            greedy.append(i)
            fill = 0
        fill += s
    assert [r.a for r in found] == greedy and [r.group for r in found] == list(range(len(greedy)))
    assert packed.select(F.spark_partition_id().alias("p")).distinct().count() > 1


@pytest.mark.parametrize(("a", "b"), [(0, 10**9), (5, 5), (7, 6), (-9, 23), (1, 62), (0, 0), (3, (1 << 40) + 11)])
def test_dyadic_cells(spark, a, b):
    cells = J.dyadic_cells(spark.createDataFrame([(a, b)], "a long, b long"), "a", "b", "level", "cell").collect()
    assert len(cells) < 100 and all(len([c for c in cells if c.level == k]) <= 2 for k in range(64))
    covered = sorted((c.cell << c.level, (c.cell + 1) << c.level) for c in cells)
    assert all(x[1] == y[0] for x, y in zip(covered, covered[1:], strict=False))
    assert (covered[0][0], covered[-1][1]) == (a, b + 1) if a <= b else not covered


def test_range_joins_of_long_ranges(spark):
    zones = [(k, a, a + R.choice([0, 1, 7, 10**6, 10**9]), R.randint(10, 40), None) for k in range(40) for a in [R.randint(0, 2000)]]
    zdf = spark.createDataFrame(zones, "zone_id long, start_i long, end_i long, qp long, bitrate_factor double")
    frames = spark.createDataFrame([(s, i) for s in range(3) for i in [*range(0, 2500, 3), 10**8]], "stream_id long, i long")
    for r in J.apply_zones(frames, zdf).collect():
        fit = [z for z in zones if z[1] <= r.i <= z[2]]
        assert (r.zone_id, r.qp) == ((fit[0][0], fit[0][3]) if fit else (None, 26))
    assert J.apply_zones(frames, zdf.limit(0)).where("zone_id is null and qp = 26").count() == frames.count()
    rects = [(g, *sorted((R.randint(0, 40), R.randint(0, 40))), *sorted((R.randint(0, 30), R.randint(0, 30)))) for g in range(5)]
    mbs = spark.createDataFrame([(x, y) for x in range(44) for y in range(33)], "x long, y long")
    for r in J.slice_group_of(mbs, spark.createDataFrame(rects, "group_id long, left long, right long, top long, bottom long"), 6).collect():
        assert r.slice_group == min((g for g, le, ri, t, b in rects if le <= r.x <= ri and t <= r.y <= b), default=5)
    segments = [(f, a, a + R.choice([0, 3, 90]), R.randint(0, 2)) for f in range(4) for a in R.sample(range(60), 4)]
    blocks = spark.createDataFrame([(f, m) for f in range(5) for m in range(64)], "frame_no long, mb long")
    for r in J.mark_segments(blocks, spark.createDataFrame(segments, "frame_no long, start_mb long, end_mb long, bad long")).collect():
        assert r.bad == max((s[3] for s in segments if s[0] == r.frame_no and s[1] <= r.mb <= s[2]), default=None)
