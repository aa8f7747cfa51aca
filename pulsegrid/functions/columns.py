"""Column expressions; none of them needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the evidence model. All comparisons with them are strict.
LOSS_OUTAGE, LOSS_DEGRADED = 0.20, 0.10
BGP_DROP, MERIT_DROP, PING_DROP = 0.05, 0.10, 0.10
WEIGHT_LOSS, WEIGHT_BGP, WEIGHT_MERIT, WEIGHT_PING = 0.35, 0.35, 0.20, 0.10
HARD, DEGRADED, POSSIBLE = 0.70, 0.45, 0.20
ORDINAL = {"hard_outage": 3, "degraded": 2, "possible": 1, "none": 0}

#: Percentiles are off by a rank in this many at most: exact in groups of up to about so many rows, and bounded in memory.
ACCURACY = 10_000


def percentile(c: str | Column, p: float) -> Column:
    return F.percentile_approx(c, F.lit(p), F.lit(ACCURACY))


def packet_loss(sent: Column, rcvd: Column) -> Column:
    """1 - rcvd / sent within [0, 1]; null where nothing was sent. A null rcvd counts as total loss: greatest and least skip nulls."""
    lost = F.lit(1.0) - F.try_divide(rcvd.cast("double"), sent.cast("double"))
    return F.when(sent > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), lost)))


def icmp_filtered(sent: Column, rcvd: Column, avg: Column) -> Column:
    """Packets went out, none came back, and no mean was reported."""
    return (sent > 0) & (rcvd == 0) & avg.isNull()


def pct_change(value: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, (value - baseline) / baseline)


def deviation_pct(value: Column, history: Column) -> Column:
    return F.when(history != 0, F.round((history - value) / history * 100, 2))


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, F.round((value - mean) / std, 4))


def step_bucket(epoch: Column, step: Column) -> Column:
    """The start of the epoch's step, floored."""
    return F.timestamp_seconds(epoch - F.pmod(epoch, step))


def step_bucket_compat(epoch: Column, step: Column) -> Column:
    """Division and multiplication in doubles: the epoch itself, or now and then a second less."""
    return F.timestamp_seconds((epoch.cast("double") / step * step).cast("long"))


def loss_evidence(loss: Column) -> Column:
    return F.when(loss > LOSS_OUTAGE, 1.0).when(loss > LOSS_DEGRADED, 0.5).otherwise(0.0)


def drop_evidence(change: Column, limit: float) -> Column:
    return F.when(change < -limit, 1.0).otherwise(0.0)


def confidence(loss: Column, bgp: Column, merit: Column, ping: Column) -> Column:
    """The weighted evidence, added left to right in doubles, on which the labels' edges depend."""
    return loss_evidence(loss) * WEIGHT_LOSS + drop_evidence(bgp, BGP_DROP) * WEIGHT_BGP + drop_evidence(merit, MERIT_DROP) * WEIGHT_MERIT + drop_evidence(ping, PING_DROP) * WEIGHT_PING


def severity(score: Column) -> Column:
    return F.when(score >= HARD, "hard_outage").when(score >= DEGRADED, "degraded").when(score >= POSSIBLE, "possible").otherwise("noise")


def severity_ordinal(label: Column) -> Column:
    out = F.lit(0)
    for name, rank in ORDINAL.items():
        out = F.when(label == name, rank).otherwise(out)
    return out


def pii_hash(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def day_parts(ts: Column) -> dict[str, Column]:
    """Partition columns, padded with zeros."""
    return {"year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"), "day": F.date_format(ts, "dd")}


def day_path(ts: Column) -> Column:
    return F.date_format(ts, "'year='yyyy'/month='MM'/day='dd")


def path_day(path: Column) -> Column:
    """The date in a path of day_path, null if there's none."""
    part = lambda k: F.regexp_extract(path, rf"{k}=(\d+)", 1)
    return F.try_to_date(F.concat_ws("-", part("year"), part("month"), part("day")))


def firmware_generation(fw: Column) -> Column:
    return F.when(fw >= 5000, "v5").otherwise("v4")


def name_or_number(name: Column, asn: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("AS"), asn.cast("string")))


def rtts(result: Column) -> Column:
    """The round-trip times of the packets that have one."""
    return F.transform(F.filter(result, lambda r: r["rtt"].isNotNull()), lambda r: r["rtt"])


def array_mean(a: Column) -> Column:
    """Mean of an array of doubles; null for an empty one."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x, lambda s: F.try_divide(s, F.size(a).cast("double")))


def half_up(c: Column, places: int) -> Column:
    """Rounded as a decimal, halves away from zero."""
    return F.round(c.cast("decimal(38,10)"), places).cast("double")


def percent_label(c: Column) -> Column:
    return F.when(c.isNull(), "—").otherwise(F.format_string("%.1f%%", c * 100))


def signed_percent_label(c: Column) -> Column:
    return F.when(c.isNull(), "—").otherwise(F.format_string("%+.1f%%", c * 100))


def iso_utc(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")
