"""Column expressions of the memory model: scores, decay, similarity, geometry, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
#: Daily decay rate by memory type. Fixed values.
DECAY_RATE = {"fact": 0.02, "decision": 0.01, "preference": 0.005, "todo": 0.15, "insight": 0.02, "context": 0.08, "instruction": 0.01, "error": 0.05, "workflow": 0.02, "reference": 0.01, "boundary": 0.0, "tool": 0.06}


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days; negative spans count as none, a null end gives null."""
    days = (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400e6
    return F.when(days.isNotNull(), F.greatest(F.lit(0.0), days))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either length is 0, null if the lengths of the arrays differ."""
    size = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), None).when(size == 0, 0.0).otherwise(dot(a, b) / size)


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(both / either)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_hash(a: Column, b: Column, limit: int = 10) -> Column:
    """Near-duplicate by hash; a hash of 0 or null matches nothing."""
    return (a != 0) & (b != 0) & (hamming(a, b) <= limit)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    rad = F.radians
    h = F.pow(F.sin((rad(lat2) - rad(lat1)) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin((rad(lon2) - rad(lon1)) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def time_factor(age_hours: Column, salience: Column) -> Column:
    """Recency of a pathway: a sigmoid around three days, or by salience if it was never conducted."""
    return F.when(age_hours.isNull(), 0.3 + 0.4 * salience).otherwise(F.greatest(F.lit(0.1), sigmoid((72 - age_hours) / 36)))


def node_decay(level: Column, rate: Column, days: Column) -> Column:
    return level * F.exp(-rate * days)


def edge_time_decay(weight: Column, hours: Column, reinforced: Column) -> Column:
    """Sigmoid forgetting whose half-life and floor grow with reinforcement."""
    half = 1440.0 * (1 + 0.5 * reinforced)
    factor = sigmoid((half - hours) / (half / 2))
    floor = 0.3 + F.least(F.lit(0.5), 0.05 * reinforced)
    return weight * F.greatest(floor, factor)


def activation_gate(level: Column) -> Column:
    return sigmoid(6 * (level - 0.5))


def heat_score(days: Column, uses: Column, priority: Column) -> Column:
    return 0.4 * F.exp(-days / 7) + 0.4 * F.least(F.lit(1.0), uses / 20) + 0.2 * clamp(priority, 0, 10) / 10


def lifecycle_state(days: Column, heat: Column) -> Column:
    cold = F.when(days < 7, "active").when(days < 30, "warm").when(days < 90, "cool").when(days < 180, "compressed").otherwise("archived")
    return F.when((heat >= 0.5) & (days >= 7), "warm").otherwise(cold)


def hebbian(weight: Column, pre: Column, post: Column, count: Column, rate: float = 0.01) -> Column:
    eta = rate * (1 + 3 * F.exp(-0.06 * count))
    return clamp(weight + eta * pre * post * (1 - weight), 0.0, 1.0)


def anti_hebbian(weight: Column, strength: Column, rate: float = 0.1) -> Column:
    return F.greatest(F.lit(0.0), weight - rate * strength * weight)


def inferred_weight(count: Column, strength: Column) -> Column:
    return F.least(F.lit(0.8), 0.3 + 0.1 * (count - 3) * strength)


def composite_score(activation: Column, priority: Column, frequency: Column, conductivity: Column, freshness: Column) -> Column:
    return 0.30 * activation + 0.25 * priority + 0.20 * frequency + 0.15 * conductivity + 0.10 * freshness


def freshness(days: Column) -> Column:
    return F.when(days < 7, 1.0).when(days < 30, 0.8).when(days < 90, 0.5).when(days < 365, 0.3).otherwise(0.1)


def freshness_bucket(days: Column) -> Column:
    return F.when(days < 7, "fresh").when(days < 30, "recent").when(days < 90, "aging").when(days < 365, "stale").otherwise("ancient")


def priority_multiplier(priority: Column, weight: float = 0.3) -> Column:
    return 1 + weight * (clamp(priority, 0, 10) - 5) / 5


def fidelity_score(activation: Column, importance: Column, hours: Column, rate: Column, floor: float = 0.05) -> Column:
    return F.greatest(F.least(F.lit(1.0), importance + activation) * F.exp(-rate * hours / 24), F.lit(floor))


def fidelity_level(score: Column, pressure: float = 0.0) -> Column:
    up = 0.3 * pressure
    return F.when(score >= 0.6 + up, "full").when(score >= 0.3 + up, "summary").when(score >= 0.1 + up, "essence").otherwise("ghost")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\r\n]+"), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    return F.floor(word_count(text) * 1.3).cast("int")


def idf(df: Column, total: Column) -> Column:
    return F.log((total + 1) / (1 + df)) / F.log(total + 1)


def anchor_limit(score: Column, low: int = 1, high: int = 5) -> Column:
    return clamp(F.ceil(score * high), low, high).cast("int")


def path_confidence(hops: Column, mean_weight: Column) -> Column:
    return F.exp(-0.4 * hops) * F.least(mean_weight, F.lit(1.0))


def hypothesis_update(confidence: Column, evidence: Column, weight: Column, sign: Column) -> Column:
    surprise = F.when(sign > 0, 1 - confidence).otherwise(confidence)
    return clamp(confidence + sign * weight * surprise * 0.3 / (1 + 0.1 * evidence), 0.01, 0.99)


def hypothesis_map(evidence: Column, weight: Column, sign: Column) -> Column:
    """``hypothesis_update`` as a map of the confidence: ``clamp(a x + b, lo, hi)``."""
    k = weight * 0.3 / (1 + 0.1 * evidence)
    return F.struct((1 - k).alias("a"), F.when(sign > 0, k).otherwise(0.0).alias("b"), F.lit(0.01).alias("lo"), F.lit(0.99).alias("hi"))


def prediction_score(days_left: Column) -> Column:
    return F.when(days_left < 0, 10.0).otherwise(10 / (1 + days_left / 3))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def structure_label(delta: Column) -> Column:
    return F.when(delta < 0.1, "tree-like").when(delta < 0.3, "hierarchical").when(delta < 0.5, "mixed").otherwise("flat")


def normalise_search(text: Column) -> Column:
    return F.lower(F.trim(text))


#: Ranges of the scripts that are written without spaces between words: Thai, Lao, Burmese, Khmer, Chinese, Japanese.
#: Ranges, since a test by script looks every character up.
UNSPACED = r"\x{e01}-\x{e5b}\x{e81}-\x{edf}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{2e80}-\x{2fdf}\x{3005}-\x{3007}\x{3041}-\x{3096}\x{309d}-\x{309f}\x{30a1}-\x{30fa}\x{30fc}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}\x{20000}-\x{3134f}"


def search_tokens(text: Column) -> Column:
    """Lower-case runs of three or more letters and digits of any script; pairs of neighbours in scripts without spaces."""
    low = F.lower(text)
    # plain letters first: most texts need no more of the pattern
    words = lambda t: F.regexp_extract_all(t, F.lit(r"([a-z0-9\p{L}\p{M}\p{N}]{3,})"), F.lit(1))
    runs = F.regexp_extract_all(low, F.lit(rf"([{UNSPACED}]+)"), F.lit(1))
    pairs = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda i: F.substring(r, i, F.lit(2))))
    unspaced = F.concat(words(F.regexp_replace(low, rf"[{UNSPACED}]", " ")), F.flatten(pairs))
    return F.when(low.rlike(rf"[{UNSPACED}]"), unspaced).otherwise(words(low))


def char_entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of a text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    return F.aggregate(
        F.array_distinct(chars),
        F.lit(0.0),
        lambda s, c: s - (F.size(F.filter(chars, lambda x: x == c)) / n) * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n),
    )


def decay_rate(memory_type: Column) -> Column:
    pairs = [F.lit(x) for kv in DECAY_RATE.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), memory_type), F.lit(0.02))


def deterministic_edge_id(source: Column, target: Column, kind: Column, symmetric: Column) -> Column:
    a = F.when(symmetric, F.least(source, target)).otherwise(source)
    b = F.when(symmetric, F.greatest(source, target)).otherwise(target)
    return F.sha2(F.concat_ws("|", a, b, kind), 256)
