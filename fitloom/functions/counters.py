"""Random numbers from counters: the draw of a row is a function of its key and its counter alone, in built-in functions.

Threefry (two words of 32 bits, 20 rounds) is a published generator of addition, rotation and exclusive or; its rounds are a fold over the
list of their constants. Rows may lie in any order and any number of partitions, be read again or be left out; each gets the number that
it always gets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.functions.scalars import bound

# Rotations of the rounds and the parity word of the key schedule.
ROTATIONS = (13, 15, 26, 6, 17, 29, 16, 24)
PARITY, MASK = 0x1BD11BDA, 0xFFFFFFFF
ROUNDS = 20
# Rational approximations of the normal quantile in its middle, its shoulders and its tails, numerators and denominators, highest power first.
MIDDLE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
SHOULDER = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


#: Of each round: the rotation, the places of the two words of the key that are added behind it (3: none), and what is added besides.
STEPS = [(ROTATIONS[i % 8], *((n % 3, (n + 1) % 3, n) if i % 4 == 3 else (3, 3, 0))) for i, n in ((i, i // 4 + 1) for i in range(ROUNDS))]


def threefry(key: tuple[Column, Column], counter: tuple[Column, Column]) -> Column:
    """Two random words of 32 bits: a struct of longs ``a`` and ``b``. Keys and counters are longs below 2**32."""
    low = lambda x: x.bitwiseAND(F.lit(MASK))
    k0, k1 = (k.cast("long") for k in key)
    keys = F.array(k0, k1, k0.bitwiseXOR(k1).bitwiseXOR(F.lit(PARITY).cast("long")), F.lit(0).cast("long"))
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(n).cast("long").alias("n")) for r, i, j, n in STEPS))

    def one(k: Column, s: Column, step: Column) -> Column:
        total = low(s["a"] + s["b"])
        turned = low(F.call_function("shiftleft", s["b"], step["r"])).bitwiseOR(F.call_function("shiftright", s["b"], 32 - step["r"])).bitwiseXOR(total)
        return F.struct(low(total + F.get(k, step["i"])).alias("a"), low(turned + F.get(k, step["j"]) + step["n"]).alias("b"))

    def run(k: Column) -> Column:
        start = F.struct(low(counter[0].cast("long") + F.get(k, F.lit(0))).alias("a"), low(counter[1].cast("long") + F.get(k, F.lit(1))).alias("b"))
        return F.aggregate(steps, start, lambda s, step: one(k, s, step))

    return bound(keys, run)


def uniform(high: Column, low: Column) -> Column:
    """A double strictly between 0 and 1 from two words: 52 bits and a half, which no rounding brings to either end."""
    return (F.shiftleft(high, 20) + F.shiftright(low, 12) + 0.5) / float(1 << 52)


def polynomial(x: Column, powers: tuple[float, ...]) -> Column:
    out = F.lit(powers[0])
    for c in powers[1:]:
        out = out * x + c
    return out


def normal_quantile(u: Column) -> Column:
    """The standard normal deviate of a probability, to about 16 digits, by rational approximations."""
    q = u - 0.5
    near = 0.180625 - q * q
    far = F.sqrt(-F.ln(F.least(u, 1.0 - u)))
    ratio = lambda x, pair: polynomial(x, pair[0]) / polynomial(x, pair[1])
    outer = F.when(far <= 5.0, ratio(far - 1.6, SHOULDER)).otherwise(ratio(far - 5.0, TAIL))
    return F.when(F.abs(q) <= 0.425, q * ratio(near, MIDDLE)).otherwise(F.when(q < 0, -outer).otherwise(outer))


def word(text: Column, which: int) -> Column:
    """The ``which``-th word of 32 bits of a text's SHA-256, as a long."""
    return F.conv(F.substring(F.sha2(text, 256), 8 * which + 1, 8), 16, 10).cast("long")


def normals(df: DataFrame, key: Column, counter: Column, name: str) -> DataFrame:
    """``df`` with a standard normal draw ``name`` of the row's ``key`` (a text) and ``counter`` (a long)."""
    # A negative counter is its two's complement.
    halves = F.shiftrightunsigned(counter.cast("long"), 32), counter.cast("long").bitwiseAND(F.lit(MASK))
    drawn = bound(threefry((word(key, 0), word(key, 1)), halves), lambda w: uniform(w["a"], w["b"]))
    return df.withColumn(name, bound(drawn, normal_quantile))


def sql_normals(source: str, key: str, counter: str, name: str) -> str:
    """The same over a table expression in DuckDB's SQL, for the tests; ``counter`` must not be negative."""
    w = lambda i: f"('0x' || substr(sha256({key}), {8 * i + 1}, 8))::UBIGINT::BIGINT"
    out = f"select *, {w(0)} as t0_, {w(1)} as t1_, ({counter}) >> 32 as a_, ({counter}) & {MASK} as b_ from ({source})"
    out = f"select * replace ((a_ + t0_) & {MASK} as a_, (b_ + t1_) & {MASK} as b_), xor(xor(t0_, t1_), {PARITY}) as t2_ from ({out})"
    for i in range(ROUNDS):
        r, n = ROTATIONS[i % 8], i // 4 + 1
        total = f"((a_ + b_) & {MASK})"
        turned = f"xor(((b_ << {r}) & {MASK}) | (b_ >> {32 - r}), {total})"
        if i % 4 == 3:
            total, turned = f"(({total} + t{n % 3}_) & {MASK})", f"(({turned} + t{(n + 1) % 3}_ + {n}) & {MASK})"
        out = f"select * replace ({total} as a_, {turned} as b_) from ({out})"
    out = f"select *, ((a_ << 20) + (b_ >> 12) + 0.5::DOUBLE) / {1 << 52}::DOUBLE as u_ from ({out})"

    def poly(x: str, powers: tuple[float, ...]) -> str:
        text = f"{powers[0]!r}::DOUBLE"
        for c in powers[1:]:
            text = f"({text} * {x} + {c!r}::DOUBLE)"
        return text

    ratio = lambda x, pair: f"({poly(x, pair[0])} / {poly(x, pair[1])})"
    far = "sqrt(-ln(least(u_, 1 - u_)))"
    outer = f"(case when {far} <= 5 then {ratio(f'({far} - 1.6::DOUBLE)', SHOULDER)} else {ratio(f'({far} - 5)', TAIL)} end)"
    value = f"case when abs(u_ - 0.5::DOUBLE) <= 0.425::DOUBLE then (u_ - 0.5::DOUBLE) * {ratio('(0.180625::DOUBLE - (u_ - 0.5::DOUBLE) * (u_ - 0.5::DOUBLE))', MIDDLE)} when u_ < 0.5 then -{outer} else {outer} end"
    return f"select * exclude (t0_, t1_, t2_, a_, b_, u_), {value} as {name} from ({out})"
