"""Column expressions: risk scores, bands, alert rules, search scores, calendar and array features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c: ColumnLike) -> Column:
    """NaN becomes NULL, so that aggregates skip it."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def mask_sentinels(c: ColumnLike, sentinels: list[float]) -> Column:
    """Values close to a sentinel (relative 1e-5, absolute 1e-8) become NULL."""
    close = [F.abs(col(c) - F.lit(s)) <= F.lit(1e-8 + 1e-5 * abs(s)) for s in sentinels]
    return F.when(reduce(Column.__or__, close), F.lit(None)).otherwise(col(c))


def positive_max(c: ColumnLike) -> Column:
    """Aggregate: the maximum, or 1 if it is 0 or there is none."""
    return F.coalesce(F.nullif(F.max(col(c)), F.lit(0.0)), F.lit(1.0))


def ratio(a: ColumnLike, b: ColumnLike, default: float = 0.0) -> Column:
    """a / b, or the default where b is 0 or null."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(default))


def exact_parts(c: ColumnLike) -> tuple[Column, Column]:
    """A double as a decimal of six digits after the point and, as a double, what it has beyond them.

    A value that no such decimal holds (from 1e12 on, infinite or NaN) is all in the second part.
    """
    value = col(c).cast("double")
    exact = value.try_cast("decimal(18,6)")
    return exact, value - F.coalesce(exact.cast("double"), F.lit(0.0))


def exact_sum(c: ColumnLike) -> Column:
    """Aggregate: the sum of doubles; of amounts below 1e12 with up to six digits after the point, the same in whatever order the rows come.

    Such amounts add up without rounding, so that totals that are equal, or equal to a bound, compare as equal; what
    values have beyond those digits is added as doubles.
    """
    exact, rest = exact_parts(c)
    return F.coalesce(F.sum(exact).cast("double"), F.lit(0.0)) + F.sum(rest)


def risk_percent(risk: ColumnLike, largest: ColumnLike, digits: int = 4) -> Column:
    """Share of the largest risk in percent, clamped to 0.1 ... 99.9."""
    share = col(risk) / col(largest) * F.lit(99.9)
    return F.round(F.least(F.lit(99.9), F.greatest(F.lit(0.1), share)), digits)


def syndemic_normalised(a: ColumnLike, max_a: ColumnLike, b: ColumnLike, max_b: ColumnLike) -> Column:
    """Geometric mean of two risks relative to their maxima, times 10."""
    return F.sqrt(col(a) / col(max_a) * (col(b) / col(max_b))) * 10.0


def syndemic_raw(a: ColumnLike, b: ColumnLike) -> Column:
    """Geometric mean of two risks, times 10, without normalising (history form)."""
    return F.sqrt(col(a) * col(b)) * 10.0


def hybrid_risk(mean: ColumnLike, largest: ColumnLike) -> Column:
    """70 % mean and 30 % maximum, so an isolated peak stays visible in an aggregate."""
    return F.lit(0.7) * col(mean) + F.lit(0.3) * col(largest)


def growth_percent(predicted: ColumnLike, current: ColumnLike) -> Column:
    """Growth in percent; 0 where there are practically no current cases."""
    return F.when(col(current) < 1e-6, F.lit(0.0)).otherwise((col(predicted) - col(current)) / col(current) * 100.0)


def alert_level(z: ColumnLike, taxonomy: ColumnLike, growth: ColumnLike) -> Column:
    """Alert level 3 to 0; the first rule that holds decides."""
    lasting = col(taxonomy).isin("Persistent", "Intensifying")
    return (
        F.when((col(z) >= 2.58) & lasting, 3)
        .when((col(z) >= 1.96) & (col(taxonomy) == "Emerging"), 2)
        .when((col(growth) > 20) | (col(z) > 1.65), 1)
        .otherwise(0)
    )


def gi_class(z: ColumnLike) -> Column:
    """Significance class of a hot-spot z score."""
    z = col(z)
    return (
        F.when(z >= 2.58, "hot 99")
        .when(z >= 1.96, "hot 95")
        .when(z >= 1.65, "hot 90")
        .when(z <= -2.58, "cold 99")
        .when(z <= -1.96, "cold 95")
        .when(z <= -1.65, "cold 90")
        .otherwise("not significant")
    )


def normal_p_value(z: ColumnLike) -> Column:
    """Two-sided normal p-value by a rational approximation (Abramowitz and Stegun 26.2.17, error < 1e-7)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(col(z)))
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)  # fixed values
    poly = reduce(lambda acc, c: (acc + F.lit(c)) * t, reversed(b), F.lit(0.0))
    return F.lit(2.0) * F.exp(-col(z) * col(z) / 2.0) / F.sqrt(F.lit(2.0) * F.pi()) * poly


def percent_band(percent: ColumnLike, high: float = 75, medium: float = 40) -> Column:
    """Badge of a risk percentage."""
    return F.when(col(percent) >= high, "high").when(col(percent) >= medium, "medium").otherwise("low")


def hot_cold_state(a: ColumnLike, b: ColumnLike, cut_a: float, cut_b: float) -> Column:
    """High/low state of two risks together."""
    side = lambda c, cut: F.when(col(c) >= cut, "High").otherwise("Low")
    return F.concat(side(a, cut_a), F.lit("-"), side(b, cut_b))


def normalised(query: str) -> str:
    return query.strip().lower()


def district_score(district: ColumnLike, state: ColumnLike, query: str) -> Column:
    """100 exact, 80 prefix, 70 start of a word, 50 anywhere, 30 in the state's name, else 0."""
    d, s, q = F.lower(col(district)), F.lower(col(state)), F.lit(normalised(query))
    return (
        F.when(d == q, 100)
        .when(d.startswith(q), 80)
        .when(F.concat(F.lit(" "), d).contains(F.concat(F.lit(" "), q)), 70)
        .when(d.contains(q), 50)
        .when(s.contains(q), 30)
        .otherwise(0)
    )


def state_score(state: ColumnLike, query: str) -> Column:
    """100 exact, 80 prefix, 50 anywhere, else 0."""
    s, q = F.lower(col(state)), F.lit(normalised(query))
    return F.when(s == q, 100).when(s.startswith(q), 80).when(s.contains(q), 50).otherwise(0)


def looks_like_cell(query: str) -> bool:
    """Whether a search text is a hexagon id or a prefix of one."""
    q = normalised(query)
    return q.startswith("87") or len(q) >= 6 and not q.strip("0123456789abcdef")


def season(week: ColumnLike) -> tuple[Column, Column]:
    """Sine and cosine of the week in a year of 52 weeks."""
    angle = F.lit(2.0) * F.pi() * col(week).cast("double") / F.lit(52.0)
    return F.sin(angle), F.cos(angle)


def iso_year(date: ColumnLike) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), col(date))


def iso_week(date: ColumnLike) -> Column:
    return F.weekofyear(col(date))


def week_start(date: ColumnLike) -> Column:
    """Monday of the date's ISO week."""
    return F.date_trunc("week", col(date)).cast("date")


def week_index(monday: ColumnLike) -> Column:
    """Weeks since Monday 1969-12-29; consecutive also over years of 53 weeks."""
    return (F.datediff(col(monday), F.lit("1969-12-29").cast("date")) / 7).cast("int")


def target_week(week: ColumnLike, ahead: int) -> Column:
    """Week number some weeks ahead, wrapped at 52."""
    return F.pmod(col(week) - 1 + ahead, F.lit(52)) + 1


def tail_slice(values: ColumnLike, first: int, last: int) -> Column:
    """Elements from `first` to before `last`, both counted from the end (last 0: to the end)."""
    v = col(values)
    start = F.greatest(F.size(v) - first, F.lit(0))
    return F.slice(v, start + 1, F.greatest(F.size(v) - last - start, F.lit(0)))


def array_sum(values: ColumnLike) -> Column:
    return F.aggregate(F.transform(col(values), lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)


def array_mean(values: ColumnLike) -> Column:
    """Mean of an array; null if it is empty."""
    return F.try_divide(array_sum(values), F.size(col(values)).cast("double"))


def hex_parent(cell: ColumnLike, resolution: int) -> Column:
    """Parent id of a hexagon id (a 64-bit index with the resolution in bits 52-55 and 3-bit digits)."""
    mask = ~(15 << 52)
    finer = (1 << (3 * (15 - resolution))) - 1
    return col(cell).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(resolution << 52)).bitwiseOR(F.lit(finer))


def hex_text(cell: ColumnLike) -> Column:
    return F.lower(F.hex(col(cell)))


def hex_number(text: ColumnLike) -> Column:
    return F.conv(col(text), 16, 10).cast("long")


def z_colour(z: ColumnLike) -> Column:
    """Red part 0 to 255 of the z score's colour ramp."""
    return (F.least(F.lit(1.0), F.greatest(F.lit(0.0), (col(z) + 2.0) / 6.0)) * 255).cast("int")


def at_least(x: ColumnLike, low: float = 0.001) -> Column:
    return F.greatest(F.lit(low), col(x))


def mean_temperature(tmax: ColumnLike, tmin: ColumnLike) -> Column:
    return (col(tmax) + col(tmin)) / 2


def daily_range(tmax: ColumnLike, tmin: ColumnLike) -> Column:
    return col(tmax) - col(tmin)


def base_rain(lon: ColumnLike, lat: ColumnLike) -> Column:
    """Expected weekly rain of a place: more in the east and in the south (fixed values)."""
    return F.when(col(lon) > 85, 100.0).otherwise(30.0) + F.when(col(lat) < 15, 60.0).otherwise(10.0)


def suitability(rain: ColumnLike, lat: ColumnLike) -> Column:
    """Share between 0 and 1 from rain and the distance to 20 degrees of latitude (fixed values)."""
    x = (col(rain) / 200.0 + (F.lit(30.0) - F.abs(col(lat) - 20.0)) / 30.0) / 2.0
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


#: fixed values: risk percent, then red, green and blue
COLOUR_STOPS = ((0, 59, 130, 246), (25, 34, 197, 94), (50, 249, 115, 22), (75, 239, 68, 68), (100, 153, 27, 27))


def risk_colour(percent: ColumnLike) -> Column:
    """(red, green, blue), linear between the stops."""
    p = F.least(F.lit(100.0), F.greatest(F.lit(0.0), col(percent)))

    def part(k: int) -> Column:
        out = F.lit(float(COLOUR_STOPS[-1][k]))
        for (a, *low), (b, *high) in reversed(list(zip(COLOUR_STOPS, COLOUR_STOPS[1:], strict=False))):
            out = F.when(p < b, low[k - 1] + (p - a) * (high[k - 1] - low[k - 1]) / float(b - a)).otherwise(out)
        return F.round(out).cast("int")

    return F.struct(*[part(k).alias(n) for k, n in enumerate(("red", "green", "blue"), 1)])


def plan_band(risk: ColumnLike) -> Column:
    """Band of a risk between 0 and 1 (thresholds .30, .60, .80)."""
    r = col(risk)
    return F.when(r >= 0.8, "critical").when(r >= 0.6, "high").when(r >= 0.3, "moderate").otherwise("low")


def label_of(key: ColumnLike) -> Column:
    """Label of a key without an entry of its own: its first word, with a capital."""
    first = F.split(col(key), "_")[0]
    return F.concat(F.upper(F.substring(first, 1, 1)), first.substr(F.lit(2), F.length(first)))


def closed_ring(lon: ColumnLike, lat: ColumnLike, half: float = 0.015, tall: float = 0.02) -> Column:
    """Corners (lon, lat) of the hexagon around a centre; the first corner closes the ring."""
    corners = ((0.0, tall), (-half, tall / 2), (-half, -tall / 2), (0.0, -tall), (half, -tall / 2), (half, tall / 2), (0.0, tall))
    return F.array(*[F.array(col(lon) + F.lit(x), col(lat) + F.lit(y)) for x, y in corners])
