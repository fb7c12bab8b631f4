"""Signal functions on arrays of doubles as column expressions; nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def energy(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def rms(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.sqrt(energy(x) / F.size(x))).otherwise(0.0)


def scale(x: Column, by: Column) -> Column:
    return F.transform(x, lambda v: v * by)


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def minus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def to_rms(x: Column, target: Column, silent: float = 1e-9) -> Column:
    """``x`` scaled to an RMS of ``target``; silent signals stay."""
    return F.when(rms(x) > silent, scale(x, target / rms(x))).otherwise(x)


def fade(x: Column, n_in: Column, n_out: Column) -> Column:
    """Half-Hann fades of at most half the length at either end."""
    half = F.floor(F.size(x) / 2)

    def weight(i: Column, n: Column) -> Column:
        return F.when(i < n, 0.5 - 0.5 * F.cos(2 * 3.141592653589793 * i / (2 * n - 1))).otherwise(1.0)

    return F.transform(x, lambda v, i: v * weight(i, F.least(n_in, half)) * weight(F.size(x) - 1 - i, F.least(n_out, half)))


#: Elements that are scanned into one array, which is copied whenever it grows.
RUN = 256


def scanned(values: Column, begin: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """The states after each of ``values``, of the type ``kind``, from ``begin`` by ``step``.

    An aggregate that collects its states copies them at every element, so they are collected in runs of ``RUN`` and the runs are put together.
    """

    def collected(state: Column, run: Column) -> Column:
        inner = F.struct(state["now"].alias("now"), F.array().cast(f"array<{kind}>").alias("out"))

        def one(s: Column, v: Column) -> Column:
            return with_value(step(s["now"], v).cast(kind), lambda n: F.struct(n.alias("now"), F.concat(s["out"], F.array(n)).alias("out")))

        return with_value(F.aggregate(run, inner, one), lambda r: F.struct(r["now"].alias("now"), F.concat(state["out"], F.array(r["out"])).alias("out")))

    start = F.struct(begin.cast(kind).alias("now"), F.array().cast(f"array<array<{kind}>>").alias("out"))

    def whole(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda i: F.slice(v, i * RUN + 1, F.lit(RUN)))
        return F.when(F.size(v) > 0, F.aggregate(runs, start, collected, lambda s: F.flatten(s["out"]))).when(F.size(v) == 0, F.array().cast(f"array<{kind}>"))

    return with_value(values, whole)


def _sum_between(sums: Column, low: Column, high: Column) -> Column:
    """From running sums, the sum of the elements from place ``low`` to ``high``, both counted from 0 and within the array."""
    return F.get(sums, high) - F.when(low > 0, F.get(sums, low - 1)).otherwise(0)


def hysteresis(p: Column, upper: float, lower: float) -> Column:
    """1 where p > upper, and where p > lower in a run that reaches upper; with lower 0 or not below upper only the first."""
    if lower <= 0 or lower >= upper:
        return F.transform(p, lambda v: (v > upper).cast("int"))

    def sweep(values: Column) -> Column:
        return scanned(values, F.lit(0), "int", lambda on, v: F.when(v > upper, 1).when((v > lower) & (on == 1), 1).otherwise(0))

    return F.zip_with(sweep(p), F.reverse(sweep(F.reverse(p))), lambda a, b: F.greatest(a, b))


def dilate(mask: Column, attack: int, release: int) -> Column:
    """On where the mask is on up to ``release`` frames before or ``attack`` frames after."""
    sums = scanned(mask, F.lit(0), "long", lambda total, v: total + (v > 0).cast("long"))

    def near(s: Column) -> Column:
        return F.transform(s, lambda v, i: (_sum_between(s, F.greatest(i - release, F.lit(0)), F.least(i + attack, F.size(s) - 1)) > 0).cast("int"))

    return with_value(sums, near)


def spread(mask: Column, width: int, n: Column) -> Column:
    """Each frame ``width`` samples long, the tail after the last frame on; fewer samples than a frame are all on."""
    long = F.flatten(F.transform(mask, lambda v: F.array_repeat(v, width)))
    padded = F.concat(long, F.array_repeat(F.lit(1), F.greatest(n - F.size(long), F.lit(0))))
    return F.when(n < width, F.array_repeat(F.lit(1), n)).otherwise(F.slice(padded, 1, n))


def zero_crossing(x: Column, at: Column, radius: int) -> Column:
    """The sample nearest to ``at`` within ``radius`` at which the sign changes; the first of two; ``at`` itself if there is none."""
    low, high = F.greatest(at - radius, F.lit(1)), F.least(at + radius, F.size(x) - 1)
    places = F.filter(F.sequence(low, high), lambda i: (F.element_at(x, i) * F.element_at(x, i + 1)) <= 0)
    nearest = F.array_min(F.transform(places, lambda i: F.struct(F.abs(i - at).alias("d"), i.alias("i"))))
    return F.coalesce(F.when(low <= high, nearest["i"]), at)


def extend_to_silence(mask: Column, start: Column, end: Column, radius: int) -> tuple[Column, Column]:
    """The latest silent frame up to ``start`` and the first from ``end`` on, within ``radius``; else the frame itself."""
    before = F.filter(F.sequence(F.greatest(start - radius, F.lit(0)), start), lambda i: F.element_at(mask, (i + 1).cast("int")) < 0.5)
    after = F.filter(F.sequence(end, F.least(end + radius, F.size(mask) - 1)), lambda i: F.element_at(mask, (i + 1).cast("int")) < 0.5)
    return F.coalesce(F.array_max(before), start), F.coalesce(F.array_min(after), end)


def cosine(x: Column, y: Column, floor: float = 1e-8) -> Column:
    size = F.sqrt(energy(x)) * F.sqrt(energy(y))
    return F.when(size > floor, dot(x, y) / size).otherwise(0.0)


def fit(x: Column, n: Column | int) -> Column:
    """``x`` cut or zero-padded to n samples."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(x), F.lit(0)))), 1, n)


def cut(x: Column, offset: Column, length: Column) -> Column:
    start = F.least(F.greatest(offset, F.lit(0)), F.size(x))
    return F.slice(x, start + 1, F.greatest(F.least(length, F.size(x) - start), F.lit(0)))


def masked(x: Column, mask: Column) -> Column:
    return F.when(F.array_max(mask) > 0, F.zip_with(x, mask, lambda a, b: a * b)).otherwise(F.transform(x, lambda v: v * 0.0))


def match_mixture(a: Column, b: Column, mix: Column, floor: float = 1e-9) -> Column:
    """The factor that gives the sum of two sources the RMS of the mixture."""
    both = rms(add(a, b))
    return F.when(both > floor, rms(mix) / both).otherwise(1.0)


def swap_needed(a: Column, b: Column, tail_a: Column, tail_b: Column) -> Column:
    """Whether crossing two continuations fits the two tails strictly better than keeping them."""
    return cosine(tail_a, b) + cosine(tail_b, a) > cosine(tail_a, a) + cosine(tail_b, b)


def si_sdr(estimate: Column, target: Column, eps: float = 1e-8) -> Column:
    """Scale-invariant signal-to-distortion ratio in dB."""
    alpha = (dot(estimate, target) + eps) / (energy(target) + eps)
    wanted = scale(target, alpha)
    return 10 * F.log10((energy(wanted) + eps) / (energy(minus(estimate, wanted)) + eps))


def activity(x: Column, level: float) -> Column:
    """The share of samples louder than ``level``."""
    return F.when(F.size(x) > 0, F.size(F.filter(x, lambda v: F.abs(v) > level)) / F.size(x)).otherwise(0.0)


def chunks(x: Column, width: int, least: int) -> Column:
    """Pieces of ``width`` samples, the last kept only if it has ``least``."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(width))
    return F.filter(F.transform(starts, lambda i: F.slice(x, i, width)), lambda c: F.size(c) >= least)


def rescaled(y: Column, x: Column, peak: float = 0.99) -> Column:
    """``y`` at the RMS of ``x``, but no sample above ``peak``."""
    by = F.when(rms(y) > 1e-9, rms(x) / rms(y)).otherwise(1.0)
    loudest = F.array_max(F.transform(y, F.abs)) * by
    return scale(y, by * F.when(loudest > peak, peak / loudest).otherwise(1.0))


#: What each task and variant keeps; the letters name the scene, the event and the reverberation that stay in.
_KEEPS = {"SER": "ser", "SR": "sr", "ER": "er", "R": "r", "SE": "se", "S": "s", "E": "e", "C": ""}


def without_components(mix: Column, variant: str, task: str, parts: dict[str, Column]) -> Column:
    """A mixture less the components that the variant drops.

    ``parts`` has speaker2, scene, event and their reverberations (``speaker1_reverb``, ``speaker2_reverb``, ``event_reverb``; null outdoors).
    ``ES`` takes the second speaker and its reverberation away always, ``EB`` and ``SB`` never.
    """
    keep, gone = _KEEPS[variant], []
    if task == "ES":
        gone += ["speaker2", "speaker2_reverb"]
    elif task not in ("EB", "SB"):
        raise ValueError(f"unknown task {task}")
    gone += ["scene"] * ("s" not in keep) + ["event", "event_reverb"] * ("e" not in keep)
    if "r" not in keep:
        gone += [p for p in ("speaker1_reverb", "speaker2_reverb", "event_reverb") if p not in gone]
    out = mix
    for name in gone:
        part = parts.get(name)
        if part is not None:
            out = F.when(part.isNull(), out).otherwise(minus(out, part))
    return out


def clean_target(first: Column, second: Column, task: str) -> Column:
    """What a task has to give back: ``EB`` both speakers' sum, ``ES`` the first, ``SB`` both apart (an array of two signals)."""
    if task == "EB":
        return add(first, second)
    if task == "ES":
        return first
    if task == "SB":
        return F.array(first, second)
    raise ValueError(f"unknown task {task}")


def better_pairing(straight: tuple[Column, Column], crossed: tuple[Column, Column], base: tuple[Column, Column]) -> Column:
    """The pairing of two streams with two sources whose scores add up to more, a tie straight: a struct of average, first, second, crossed and the
    baselines of the sources that the streams were paired with."""
    takes = straight[0] + straight[1] >= crossed[0] + crossed[1]

    def pick(a: Column, b: Column) -> Column:
        return F.when(takes, a).otherwise(b)

    one, two = pick(straight[0], crossed[0]), pick(straight[1], crossed[1])
    return F.struct(((one + two) / 2).alias("average"), one.alias("first"), two.alias("second"), (~takes).alias("crossed"), pick(*base).alias("base_first"), pick(base[1], base[0]).alias("base_second"))


def common_length(x: Column, y: Column) -> tuple[Column, Column]:
    """Both signals cut to the shorter one."""
    n = F.least(F.size(x), F.size(y))
    return F.slice(x, 1, n), F.slice(y, 1, n)


def or_nan_if_silent(value: Column, target: Column, level: float, least: float = 0.01) -> Column:
    """NaN where less than ``least`` of the target's samples are louder than ``level``."""
    return F.when(activity(target, level) < least, F.lit(float("nan"))).otherwise(value)


def skippable(x: Column, shortest: int, peak: float = 1e-4) -> Column:
    """Whether a stream is shorter than ``shortest`` samples or never reaches ``peak``."""
    return (F.size(x) < shortest) | (F.coalesce(F.array_max(F.transform(x, F.abs)), F.lit(0.0)) < peak)


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _frames(x: Column, at: Callable[[Column], Column]) -> Column:
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.size(x) - 1), at))


def _around(mask: Column, before: int, after: int, judge: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """For each frame ``judge`` of the number of frames that are on from ``before`` frames before to ``after`` after it, its place and the ends of that range."""

    def counted(sums: Column) -> Column:
        def at(i: Column) -> Column:
            low, high = F.greatest(i - before, F.lit(0)), F.least(i + after, F.size(sums) - 1)
            return judge(_sum_between(sums, low, high), i, low, high)

        return _frames(sums, at)

    return with_value(scanned(mask, F.lit(0), "long", lambda total, v: total + v.cast("long")), counted)


def _dilated(mask: Column, width: int) -> Column:
    """On wherever one of the ``width`` frames around is on; the window of an even width is one longer to the right."""
    return _around(mask, width - width // 2 - 1, width // 2, lambda n, i, low, high: n > 0)


def _eroded(mask: Column, width: int) -> Column:
    """On only where all of the ``width`` frames around are on, frames outside being off; the window of an even width is one longer to the left."""
    return _around(mask, width // 2, width - width // 2 - 1, lambda n, i, low, high: n == width)


def energy_mask(x: Column, frame: int, close: int, open: int, relative: float = 0.07, floor: float = 1e-4) -> Column:
    """Where the moving RMS of ``frame`` samples is above ``relative`` of its peak: an array of booleans, gaps below ``close`` samples closed first,
    then runs below ``open`` opened; null for an empty signal.  Samples outside the signal are zero and no activity."""
    before, after = frame // 2, frame - frame // 2 - 1

    def envelope(square: Column) -> Column:
        def at(i: Column) -> Column:
            low, high = F.greatest(i - before, F.lit(0)), F.least(i + after, F.size(square) - 1)
            return F.sqrt(F.aggregate(F.slice(square, low + 1, high - low + 1), F.lit(0.0), lambda a, v: a + v) / frame)

        return _frames(square, at)

    loud = with_value(with_value(F.transform(x, lambda v: v * v), envelope), lambda e: F.transform(e, lambda v: v > F.greatest(F.array_max(e) * relative, F.lit(floor))))
    return _dilated(_eroded(_eroded(_dilated(loud, close), close), open), open)


def peaks(x: Column, buckets: int) -> Column:
    """The loudest sample of each of ``buckets`` stretches in percent of the loudest of all, whole, halves to the even; 0 for a stretch without any."""

    def scaled(loud: Column) -> Column:
        def at(i: Column) -> Column:
            low, high = (F.floor(k * F.size(loud) / buckets).cast("int") for k in (i, i + 1))
            most = F.coalesce(F.array_max(F.slice(loud, low + 1, high - low)), F.lit(0.0))
            return F.bround(most / F.coalesce(F.nullif(F.array_max(loud), F.lit(0.0)), F.lit(1.0)) * 100).cast("int")

        return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), at)

    return with_value(F.transform(x, F.abs), scaled)


def middle(values: Column) -> Column:
    """The median of an array, NaN of an empty one."""
    n, ordered = F.size(values), F.array_sort(values)
    return F.when(n == 0, F.lit(float("nan"))).otherwise((F.element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.element_at(ordered, F.floor(n / 2 + 1).cast("int"))) / 2)


def chunk_median(estimate: Column, target: Column, width: int, least: int, level: float, active: float, score: Callable[[Column, Column], Column]) -> Column:
    """The median ``score`` of chunks of ``width`` samples: a struct of it, how many were scored, and how many were not.

    A target chunk of fewer than ``least`` samples is short, else one of which less than ``active`` is louder than ``level`` is silent; a null score is
    an error.
    """
    starts = F.when(F.size(target) > 0, F.sequence(F.lit(1), F.size(target), F.lit(width))).otherwise(F.array().cast("array<int>"))

    def judged(i: Column) -> Column:
        e, r = F.slice(estimate, i, width), F.slice(target, i, width)
        kind = F.when(F.size(r) < least, "short").when(activity(r, level) < active, "silent").otherwise("scored")
        return F.struct(kind.alias("kind"), F.when(kind == "scored", score(e, r)).alias("score"))

    def summed(chunks: Column) -> Column:
        def count(kind: str, missing: bool = False) -> Column:
            return F.size(F.filter(chunks, lambda c: (c["kind"] == kind) & (c["score"].isNull() == missing)))

        scores = F.transform(F.filter(chunks, lambda c: c["score"].isNotNull()), lambda c: c["score"])
        return F.struct(
            middle(scores).alias("median"), count("scored").alias("n_scored"), count("silent", True).alias("n_skipped_silent"), count("short", True).alias("n_skipped_short"), count("scored", True).alias("n_errored")
        )

    return with_value(F.transform(starts, judged), summed)
