"""Polish cardinal numbers in words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Polish words for numbers.
_UNITS = "zero jeden dwa trzy cztery pięć sześć siedem osiem dziewięć dziesięć jedenaście dwanaście trzynaście czternaście piętnaście szesnaście siedemnaście osiemnaście dziewiętnaście".split()
_TENS = "dwadzieścia trzydzieści czterdzieści pięćdziesiąt sześćdziesiąt siedemdziesiąt osiemdziesiąt dziewięćdziesiąt".split()
_HUNDREDS = "sto dwieście trzysta czterysta pięćset sześćset siedemset osiemset dziewięćset".split()
_GROUPS = [
    ("tysiąc", "tysiące", "tysięcy"), ("milion", "miliony", "milionów"), ("miliard", "miliardy", "miliardów"), ("bilion", "biliony", "bilionów"), ("biliard", "biliardy", "biliardów"),
    ("trylion", "tryliony", "trylionów"), ("tryliard", "tryliardy", "tryliardów"), ("kwadrylion", "kwadryliony", "kwadrylionów"), ("kwadryliard", "kwadryliardy", "kwadryliardów"),
    ("kwintylion", "kwintyliony", "kwintylionów"),
]


#: Longer runs of digits stay as they are: there is no word for their thousands.
DIGITS = 3 * (len(_GROUPS) + 1)


def _word(words: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), index.cast("int"))


def _below_thousand(n: Column) -> list[Column]:
    """The words of a number from 0 to 999; null where there is none."""
    rest = n % 100
    return [
        F.when(n >= 100, _word(_HUNDREDS, F.floor(n / 100))),
        F.when(rest >= 20, _word(_TENS, F.floor(rest / 10) - 1)),
        F.when((rest >= 20) & (rest % 10 > 0), _word(_UNITS, rest % 10 + 1)).when((rest > 0) & (rest < 20), _word(_UNITS, rest + 1)),
    ]


def in_words(digits: Column) -> Column:
    """A run of ASCII digits as words; unchanged beyond ``DIGITS`` digits.  Leading zeros do not count."""
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    padded = F.lpad(plain, DIGITS, "0")
    forms = F.array(*[F.array(*map(F.lit, f)) for f in _GROUPS])

    def words(k: Column) -> Column:
        """The words of the k-th group of three from the right."""
        part = F.substring(padded, DIGITS - 2 - 3 * k, F.lit(3)).cast("int")
        few = (part % 10).isin(2, 3, 4) & ~(part % 100).isin(12, 13, 14)
        form = F.get(F.get(forms, k - 1), F.when(part == 1, 0).when(few, 1).otherwise(2))
        counted = [F.when((part > 1) | (k == 0), w) for w in _below_thousand(part)]
        return F.concat_ws(" ", *counted, F.when((k > 0) & (part > 0), form))

    groups = F.transform(F.sequence(F.lit(len(_GROUPS)), F.lit(0)), words)
    return F.when(F.length(plain) > DIGITS, digits).when(plain == "0", _UNITS[0]).otherwise(F.array_join(F.filter(groups, lambda w: w != ""), " "))


def spell_numbers(tokens: Column) -> Column:
    """Token lists with runs of ASCII digits replaced by their words."""
    return F.flatten(F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]+$"), F.split(in_words(t), " ")).otherwise(F.array(t))))


def in_words_sql(t: str) -> str:
    """The same as a DuckDB expression over the text expression ``t``."""

    def pick(words: list[str], at: str) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + f"][{at}]"

    def below(p: str) -> list[str]:
        return [
            f"CASE WHEN {p} >= 100 THEN {pick(_HUNDREDS, f'{p} // 100')} END",
            f"CASE WHEN {p} % 100 >= 20 THEN {pick(_TENS, f'{p} % 100 // 10 - 1')} END",
            f"CASE WHEN {p} % 100 >= 20 AND {p} % 10 > 0 THEN {pick(_UNITS, f'{p} % 10 + 1')} WHEN {p} % 100 BETWEEN 1 AND 19 THEN {pick(_UNITS, f'{p} % 100 + 1')} END",
        ]

    plain = f"CASE WHEN ltrim({t}, '0') = '' THEN '0' ELSE ltrim({t}, '0') END"
    parts = []
    for k in range(len(_GROUPS), -1, -1):
        p = f"CAST(substr(lpad({plain}, {DIGITS}, '0'), {DIGITS - 2 - 3 * k}, 3) AS INTEGER)"
        if k:
            one, few, many = _GROUPS[k - 1]
            form = f"CASE WHEN {p} = 1 THEN '{one}' WHEN {p} % 10 IN (2, 3, 4) AND {p} % 100 NOT IN (12, 13, 14) THEN '{few}' WHEN {p} > 0 THEN '{many}' END"
            parts += [f"CASE WHEN {p} > 1 THEN {w} END" for w in below(p)] + [form]
        else:
            parts += below(p)
    return f"CASE WHEN length({plain}) > {DIGITS} THEN {t} WHEN {plain} = '0' THEN '{_UNITS[0]}' ELSE concat_ws(' ', {', '.join(parts)}) END"
