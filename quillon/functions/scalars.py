"""Scalar building blocks as Column expressions: probabilities, entropies, hashes, normalised strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 0.01
#: White space as Unicode has it, in a form that Java's and RE2's patterns share (fixed values).
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def uniform(salt: str, *ids: Column | str) -> Column:
    """A reproducible draw from [0, 1): the first 32 bits of md5(salt#id#id...)."""
    parts = [F.lit(salt)] + [(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]
    return F.conv(F.substring(F.md5(F.concat_ws("#", *parts)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def clip(p: Column, epsilon: float = EPSILON) -> Column:
    return F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - epsilon))


def logit(p: Column, epsilon: float = EPSILON) -> Column:
    q = clip(p, epsilon)
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0))))


def temper(p: Column, temperature: float) -> Column:
    """Temperature scaling on the log odds."""
    return sigmoid(logit(p, 1e-6) / F.lit(temperature))


def centred_log_ratios(probabilities: Column, options: Sequence[str], epsilon: float = EPSILON) -> list[Column]:
    """ln of each option's probability less their mean, in the options' order; an option that is missing counts as 0."""
    logs = [F.ln(F.greatest(F.coalesce(F.try_element_at(probabilities, F.lit(o)), F.lit(0.0)), F.lit(epsilon))) for o in options]
    mean = sum(logs[1:], logs[0]) / len(logs)
    return [x - mean for x in logs]


def normalized_entropy(values: Column) -> Column:
    """Entropy of an array of masses over ln K; 0 for fewer than two or no mass."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    raw = F.aggregate(values, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.ln(x / total)).otherwise(0.0))
    return F.when((F.size(values) < 2) | (total <= 0), 0.0).otherwise(raw / F.ln(F.greatest(F.size(values), F.lit(2)).cast("double")))


def binary_entropy(p: Column) -> Column:
    q = clip(p, 1e-9)
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


def expected_level(masses: Column) -> Column:
    """Mean level of an array of masses by level, as a share of the highest level."""
    total = F.aggregate(masses, F.lit(0.0), lambda a, x: a + x)
    moment = F.aggregate(F.transform(masses, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, moment / total / F.greatest(F.size(masses) - 1, F.lit(1))).otherwise(0.0)


def argmax_key(masses: Column) -> Column:
    """The key of a map's largest value; equal values go to the smaller key."""
    return F.array_sort(F.transform(F.map_entries(masses), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))[0]["k"]


# -- strings ---------------------------------------------------------------------------------------------------------


#: The same characters one by one (fixed values).
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends; looks at the ends alone, however much white space there is inside."""
    return F.btrim(x, F.lit(SPACES))


def normalize_prediction(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), f"{SPACE}+", " "))


def normalize_label(x: Column) -> Column:
    """Lower-cased, without outer white space and final .!?; nothing and nan are '', n/a is na."""
    bare = strip(F.rtrim(strip(F.lower(F.coalesce(x, F.lit("")))), F.lit(".!?")))
    return F.when(bare == "nan", "").when(bare == "n/a", "na").otherwise(bare)


#: Spellings of nothing (fixed values).
NOTHING = ("", "nan", "n/a", "none", "null")


def agrees(prediction: Column, label: Column) -> Column:
    """Whether both say the same once all spellings of nothing are na; a prediction keeps its punctuation."""
    blank = lambda x: F.when(x.isin(*NOTHING), "na").otherwise(x)
    return blank(normalize_prediction(F.coalesce(prediction, F.lit("")))) == blank(normalize_label(label))


def interpreted(kind: Column, noul: Column, choice: Column, masses: Column, score: Column) -> Column:
    """struct(value, confidence) of an answer: yes or no at 0.5, a choice with its mass (0 without one), a level without confidence."""
    value = F.when(kind == "noul", F.when(noul >= 0.5, "Yes").otherwise("No")).when(kind == "choice", choice).otherwise(score.cast("string"))
    confidence = F.when(kind == "noul", F.greatest(noul, 1 - noul)).when(kind == "choice", F.coalesce(F.try_element_at(masses, choice), F.lit(0.0))).otherwise(0.0)
    return F.struct(value.alias("value"), confidence.alias("confidence"))


def described(kind: Column, noul: Column, choice: Column, masses: Column, score: Column) -> Column:
    """A short line for an answer."""
    mass = F.try_element_at(masses, choice)
    chosen = F.concat(choice, F.when(mass.isNotNull(), F.format_string(" (%.0f%%)", F.bround(mass * 100, 0))).otherwise(""))
    return F.when(kind == "noul", F.format_string("%.0f%% yes", F.bround(noul * 100, 0))).when(kind == "choice", chosen).when(kind == "score", F.format_string("%.1f", F.bround(score, 1))).otherwise("?")


def split_feature(name: Column) -> Column:
    """struct(element, term) of a feature's name; self.holistic and shared.<key> count as elements."""
    pattern = r"\A(self\.holistic|shared\.[^.]*|[^.]*)(?:\.(.*))?\z"
    return F.struct(F.regexp_extract(name, pattern, 1).alias("element"), F.regexp_extract(name, pattern, 2).alias("term"))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def cache_key(fingerprint: Column, text: Column) -> Column:
    """sha256 of a question set's fingerprint, a zero character and the text."""
    return F.sha2(F.concat(fingerprint, F.char(F.lit(0)), text), 256)


# -- serving ---------------------------------------------------------------------------------------------------------


def softmax(logits: Sequence[Column]) -> list[Column]:
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    powers = [F.exp(z - top) for z in logits]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def softmax_array(logits: Column, temperature: float = 1.0) -> Column:
    """Softmax of an array of logits."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda z: F.exp((z - top) / F.lit(temperature)))
    return F.transform(F.array(powers), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))[0]


def calibrated(confidence: Column, table: Sequence[float]) -> Column:
    """Piecewise-linear lookup in a table over the uniform grid 0..1; ends clamp."""
    last = len(table) - 1
    values = F.array(*[F.lit(float(v)) for v in table])
    x = F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)) * last
    low = F.least(F.floor(x), F.lit(last - 1)).cast("int")
    at = lambda i: F.element_at(values, i + 1)
    return at(low) + (x - low) * (at(low + 1) - at(low))


def title(x: Column) -> Column:
    """Stripped, and the first letter of every run of letters upper case, the others lower."""
    pieces = F.regexp_extract_all(strip(x), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2))))), "")


def legend_differs(legend: Column, levels: int) -> Column:
    """Whether an answer's legend has other than the question's number of levels; without a legend it doesn't."""
    return legend.isNotNull() & (F.size(legend) != levels)


def matching_legend(legend: Column, levels: int) -> Column:
    """The legend, or an error if its levels aren't the question's: the rubric has changed since."""
    message = F.concat(F.lit("legend has "), F.size(legend).cast("string"), F.lit(f" levels, the question {levels}"))
    return F.when(legend_differs(legend, levels), F.raise_error(message).cast("array<string>")).otherwise(legend)


def json_reply(text: Column) -> Column:
    """The JSON object in a reply that may have prose or a code fence around it, as text: the first fenced one, else what is from the
    first { to the last }. Null, a refusal, if neither is one whole object; an object with a key twice is none."""
    # what stands between fences is every second piece; one that opens with { (after a language's name) may be the object
    pieces = F.transform(F.split(text, "```"), lambda piece, i: F.when(i % 2 == 1, F.regexp_replace(strip(piece), r"\A(?:json)?\s*(?=\{)", "")))
    closed = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))  # the last piece has no fence after it
    fenced = F.get(F.filter(closed, lambda piece: piece.startswith("{") & piece.endswith("}")), F.lit(0))
    plain = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))

    def whole(x: Column) -> Column:
        # in brackets, text after the object's end is an error or a second element
        parsed = F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
        return F.when(parsed.isNotNull() & F.try_variant_get(parsed, "$[1]", "variant").isNull(), x)

    return F.coalesce(whole(fenced), whole(plain))
