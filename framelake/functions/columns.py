"""Exact column arithmetic on clocks, codes, quantisers, positions, samples and payload bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quantiser steps of the first six indices; later ones double every six.
QSTEPS = (0.625, 0.6875, 0.8125, 0.875, 1.0, 1.125)
#: Slice types by number modulo 5.
SLICE_TYPES = ("P", "B", "I", "SP", "SI")
MAX_QP = 51


def idiv(a: Column, b: Column | int) -> Column:
    """Integer division that truncates, as in C."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def rescale_ts(ticks: Column, from_tb: tuple[int, int], to_tb: tuple[int, int], mode: str = "near") -> Column:
    """Ticks of one clock (num, den) in another, exactly; null stays null.

    ``near``: nearest, halves away from zero; ``up``: towards plus infinity.
    """
    b, c = from_tb[0] * to_tb[1], from_tb[1] * to_tb[0]
    a = ticks.cast("decimal(20,0)")
    if mode == "near":
        size = idiv(2 * F.abs(a) * F.lit(b).cast("decimal(17,0)") + F.lit(c), 2 * c)
        return F.when(a < 0, -size).otherwise(size).cast("long")
    if mode != "up":
        raise ValueError(f"mode {mode!r} is neither near nor up")
    product = a * F.lit(b).cast("decimal(17,0)")
    down = idiv(product, c)
    return F.when((product > 0) & (product % c != 0), down + 1).otherwise(down).cast("long")


def nal_header_fields(b0: Column) -> Column:
    """Struct of the three fields of a unit's first byte."""
    return F.struct(
        F.shiftright(b0, 7).bitwiseAND(1).alias("forbidden"), F.shiftright(b0, 5).bitwiseAND(3).alias("ref_idc"),
        b0.bitwiseAND(31).alias("nal_type"),
    )


def nal_header_byte(forbidden: Column, ref_idc: Column, nal_type: Column) -> Column:
    return F.shiftleft(forbidden, 7).bitwiseOR(F.shiftleft(ref_idc, 5)).bitwiseOR(nal_type)


def byte_at(payload: Column, at: int) -> Column:
    """Unsigned byte ``at`` (from 0), null beyond the end."""
    return F.conv(F.hex(F.substring(payload, at + 1, 1)), 16, 10).cast("long")


def _number(payload: Column, at: int, n: int, little: bool) -> Column:
    order = range(n) if little else range(n - 1, -1, -1)
    out = F.lit(0).cast("long")
    for power, k in enumerate(order):
        out = out + byte_at(payload, at + k) * (1 << (8 * power))
    return out


RTP_LAYOUTS = ("low_first", "rfc3550")


def rtp_header_fields(packet: Column, layout: str = "rfc3550") -> Column:
    """Struct of the header fields of an RTP packet and its payload.

    ``low_first`` packs bit fields from the low end and numbers little-endian, ``rfc3550`` as the standard.
    """
    if layout not in RTP_LAYOUTS:
        raise ValueError(f"layout {layout!r} is none of {RTP_LAYOUTS}")
    b0, b1 = byte_at(packet, 0), byte_at(packet, 1)
    low = layout == "low_first"
    bits = (lambda c, lo, n: F.shiftright(c, lo if low else 8 - lo - n).bitwiseAND((1 << n) - 1))
    return F.struct(
        bits(b0, 0, 2).alias("version"), bits(b0, 2, 1).alias("padding"), bits(b0, 3, 1).alias("extension"), bits(b0, 4, 4).alias("csrc_count"),
        bits(b1, 0, 1).alias("marker"), bits(b1, 1, 7).alias("payload_type"),
        _number(packet, 2, 2, low).alias("seq"), _number(packet, 4, 4, low).alias("timestamp"), _number(packet, 8, 4, low).alias("ssrc"),
        F.substring(packet, 13, 1 << 30).alias("payload"),
    )


def rtp_valid(packet: Column, fields: Column) -> Column:
    """Version 2, no padding, extension or contributing sources, and a whole header."""
    plain = (fields["version"] == 2) & (fields["padding"] == 0) & (fields["extension"] == 0) & (fields["csrc_count"] == 0)
    return F.coalesce((F.octet_length(packet) >= 12) & plain, F.lit(False))


def strip_emulation(payload: Column) -> Column:
    """Without each 03 that follows exactly two zeros."""
    text = F.decode(payload, "ISO-8859-1")
    return F.encode(F.regexp_replace(text, "(?<!\\x00)\\x00\\x00\\x03", "\u0000\u0000"), "ISO-8859-1")


def insert_emulation(payload: Column) -> Column:
    """With 03 before each byte up to 03 that follows two zeros."""
    text = F.decode(payload, "ISO-8859-1")
    return F.encode(F.regexp_replace(text, "\\x00\\x00(?=[\\x00-\\x03])", "\u0000\u0000\u0003"), "ISO-8859-1")


def payload_bits(payload: Column) -> Column:
    """Bits before the stop bit, the last 1; trailing zero bytes do not count. No 1 bit: 0."""
    text = F.regexp_replace(F.decode(payload, "ISO-8859-1"), "\\x00+\\z", "")
    n = F.length(text).cast("long")
    last = F.conv(F.hex(F.encode(F.substring(text, -1, 1), "ISO-8859-1")), 16, 10).cast("long")
    low = F.log2(last.bitwiseAND(-last)).cast("long")
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(8 * n - low - 1)


def slice_lead_fields(payload: Column) -> Column:
    """Struct of the first three unsigned codes of a slice: first unit, type modulo 5, picture set.

    ``payload`` starts with the header byte and has no emulation bytes; eight bytes hold the codes.
    """
    bits = F.concat(F.lpad(F.conv(F.hex(F.rpad(F.substring(payload, 2, 8), 8, b"\0")), 16, 2), 64, "0"), F.repeat(F.lit("0"), 64))

    def read(text: Column) -> tuple[Column, Column]:
        zeros = F.instr(text, "1") - 1
        return F.conv(text.substr(zeros + 1, zeros + 1), 2, 10).cast("long") - 1, text.substr(2 * zeros + 2, F.lit(128))

    first, rest = read(bits)
    kind, rest = read(rest)
    pps, _ = read(rest)
    return F.struct(first.alias("first_mb"), F.pmod(kind, F.lit(5)).alias("slice_type"), pps.alias("pps_id"))


def se_to_code(v: Column) -> Column:
    return F.when(v > 0, 2 * v - 1).otherwise(-2 * v)


def ue_bits(v: Column) -> Column:
    """Length of the unsigned Exp-Golomb code."""
    return (2 * F.length(F.bin((v + 1).cast("long"))) - 1).cast("long")


def se_bits(v: Column) -> Column:
    return ue_bits(se_to_code(v))


def ue_code(v: Column) -> Column:
    """The code's bits as text."""
    bits = F.bin((v + 1).cast("long"))
    return F.concat(F.repeat(F.lit("0"), F.length(bits) - 1), bits)


def slice_type_name(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SLICE_TYPES)), (F.pmod(n, F.lit(5)) + 1).cast("int"))


def qp_to_qstep(qp: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, QSTEPS)), (F.pmod(qp, F.lit(6)) + 1).cast("int")) * F.pow(F.lit(2.0), idiv(qp, 6))


def qstep_upper_bounds() -> list[float]:
    """For each quantiser index the largest step that is nearest to its own (halves go down)."""
    middles = [(a + b) / 2 for a, b in zip(QSTEPS, QSTEPS[1:], strict=False)] + [QSTEPS[-1]]
    return [middles[i % 6] * 2 ** (i // 6) for i in range(MAX_QP + 1)]


def qstep_to_qp(q: Column) -> Column:
    """Nearest index: the number of indices whose upper bound lies below the step, at most the last.

    Bounds double every six indices, so a logarithm gives the octave and six comparisons the rest.
    """
    bounds = qstep_upper_bounds()[:6]
    octave = F.floor(F.log2(q / bounds[0]))
    scale = F.pow(F.lit(2.0), octave)
    inside = sum(((scale * b < q).cast("long") for b in bounds), F.lit(0).cast("long"))
    return F.when(q > bounds[0], F.least(F.lit(MAX_QP).cast("long"), 6 * octave + inside)).when(q.isNotNull(), F.lit(0).cast("long"))


def mb_xy(mb: Column, width: Column | int) -> Column:
    w = width if isinstance(width, Column) else F.lit(width)
    return F.struct(F.pmod(mb, w).alias("x"), idiv(mb, w).alias("y"))


def block_pos(idx: Column) -> Column:
    """Row and column, in 4x4 blocks, of a block's number: 8x8 areas first, blocks within next."""
    return F.struct(
        (idiv(idx, 8) * 2 + idiv(F.pmod(idx, F.lit(4)), 2)).alias("row"),
        (F.pmod(idiv(idx, 4), F.lit(2)) * 2 + F.pmod(idx, F.lit(2))).alias("col"),
    )


def block_index(row: Column, col: Column) -> Column:
    return idiv(row, 2) * 8 + idiv(col, 2) * 4 + F.pmod(row, F.lit(2)) * 2 + F.pmod(col, F.lit(2))


def clamp(v: Column, lo: int, hi: int) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def apply_gain(samples: Column, gain: float) -> Column:
    return F.transform(samples, lambda s: s * gain)


def to_s16(samples: Column) -> Column:
    return F.transform(samples, lambda s: clamp(F.round(s * 32768), -32768, 32767).cast("int"))


def downmix(samples: Column) -> Column:
    """Mean over the channels of a sample."""
    return F.aggregate(samples, F.lit(0.0), lambda a, s: a + s) / F.size(samples)


def interleave(left: Column, right: Column) -> Column:
    """Sample i of the first channel, sample i of the second, and so on."""
    return F.flatten(F.zip_with(left, right, lambda a, b: F.array(a, b)))


def deinterleave(samples: Column, n: int, channel: int) -> Column:
    return F.filter(samples, lambda _, i: i % n == channel)


def weight_pixels(v: Column, w: Column) -> Column:
    return clamp(F.shiftright((v * w + 16).cast("long"), 5), 0, 255)


def coeff_stats(c: Column) -> Column:
    """Struct of a coefficient block: non-zeros, trailing ones (at most 3), zeros below the last
    non-zero, and the zeros before each non-zero from the last to the second."""
    nonzero = F.filter(F.transform(c, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda e: e["v"] != 0)
    total = F.size(nonzero)
    from_end = F.reverse(nonzero)
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("stop"))
    ones = F.aggregate(
        from_end, start,
        lambda a, e: F.struct(
            (a["n"] + (~a["stop"] & (F.abs(e["v"]) == 1) & (a["n"] < 3)).cast("int")).alias("n"), (a["stop"] | (F.abs(e["v"]) > 1)).alias("stop")
        ),
    )["n"]
    last = F.coalesce(F.get(from_end, F.lit(0))["i"], F.lit(-1))
    gaps = F.transform(from_end, lambda e, k: e["i"] - F.coalesce(F.get(from_end, k + 1)["i"], F.lit(-1)) - 1)
    return F.struct(
        total.alias("total"), ones.alias("trailing_ones"), (last - total + 1).alias("total_zeros"),
        F.when(total > 1, F.slice(gaps, 1, F.greatest(total - 1, F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)")).alias("runs_before"),
    )
