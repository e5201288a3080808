"""Personal data by candidate generation and gradient boosting, in DataFrame expressions alone.

1. High-recall generators (one pattern per kind) propose spans, which may overlap across kinds. A pattern is run as
   ``regexp_extract_all`` for the matches and ``split`` for the gaps between them; positions in code points are the running
   sums of both lengths. A cheap test of the whole text keeps the patterns away from texts without a candidate.
2. Each candidate has format features (length, digits, letters, separators) and context features (key words before it, what
   touches it), all of them small integers. A format check per kind (octets, Luhn, digit counts, area numbers, mod 97)
   labels it, but for kinds whose check proves little (``EVIDENCE``: most random numbers are possible ssn). Their labels come
   from evidence the trees do not see: a key word of the kind before a passing span says yes; a failed check, or a word for
   other numbers (part, order, ...) nearer to the span, says no; a passing span with neither has no label.
3. Training counts labels by distinct feature vector over ALL candidates. There are at most a few thousand such vectors
   whatever the corpus, so the driver boosts shallow trees on the counts, and finds for each kind the least score above
   which ``precision`` of the labelled candidates are positive, half-way to the next lower one; a kind that never reaches
   it adds nothing by score.
4. Scores are nested CASE expressions. Spans that pass their check stay in any case for the four base kinds. Unless they
   overlap one of those, spans of the added kinds whose check proves stay too, and other candidates are selected by score:
   an ssn always, unless no ssn of the corpus has a key word, when nothing could be learned and its check decides.

Candidates are computed once, per row, and written; nothing is shuffled but the counts.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from excerpta.llm.common import settle

# Kinds in the order of reporting; the first four are the base kinds. (pattern, test of the whole text)
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9]))", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{3}"),
    "secret": (r"(?i)(?:password|passwd|secret|token|api[_-]?key)[\x22']?\s{0,3}[:=]\s{0,3}[\x22']?[A-Za-z0-9_/+.-]{6,}", r"(?i)password|passwd|secret|token|api[_-]?key"),
}
NAMES = list(KINDS)
BASE = 4
WORDS = {
    "email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|credit|payment", "phone": "tel|phone|call|fax|mobile",
    "ssn": "ssn|social", "iban": "iban|account|bank", "secret": "login|user|auth|key",
}
# Kinds labelled by evidence, and words before a span that say it is another kind of number.
EVIDENCE = ("ssn",)
OTHER_NUMBERS = r"\b(?:parts?|order|item|serial|model|invoice|ref|sku|lot|batch|version|ticket|tracking)\b"
FEATURES = ("kind", "length", "digits", "letters", "others", "context", "touched", "checked", "adverse")
PRECISION = 0.98
RUN = 256


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(lengths: Column) -> Column:
    """Inclusive running sums of an array, in runs of ``RUN`` so that the cost stays linear."""

    def sums(values, start):
        begin = F.struct(start.alias("s"), F.array().cast("array<int>").alias("a"))
        return F.aggregate(values, begin, lambda acc, x: F.struct((acc.s + x).alias("s"), F.concat(acc.a, F.array(acc.s + x)).alias("a"))).a

    def total(values):
        return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)

    runs = F.transform(F.sequence(F.lit(1), F.size(lengths), F.lit(RUN)), lambda at: F.slice(lengths, at, RUN))
    firsts = lambda rs: sums(F.transform(rs, total), F.lit(0))
    parts = bind(runs, lambda rs: bind(firsts(rs), lambda upto: F.transform(rs, lambda r, i: sums(r, F.get(upto, i) - total(r)))))
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(F.flatten(parts))


def _only(value: Column, what: str) -> Column:
    return F.regexp_replace(value, f"[^{what}]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""

    def weight(c, i):
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    places = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)))
    return F.aggregate(F.transform(places, weight), F.lit(0), lambda acc, x: acc + x) % 10 == 0


def _mod97(value: Column) -> Column:
    plain = _only(value, "A-Z0-9")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def step(acc, at):
        c = F.substring(turned, at, F.lit(1))
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _iban(head: Column, tail: Column) -> Column:
    """The longest of the ends of an IBAN that pass mod 97, or else all of it. Ends are the tail's and those before a
    space: an upper-case word or a number that follows an IBAN matches its pattern too."""

    def shorter(words):
        cut = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
        return F.filter(cut, lambda t: F.length(_only(t, "A-Z0-9")) >= 11)

    whole = bind(F.split(tail, " "), lambda words: F.transform(shorter(words), lambda t: F.concat(head, t)))
    return F.coalesce(F.get(F.filter(whole, _mod97), F.lit(0)), F.concat(head, tail))


def _check(name: str, value: Column) -> Column:
    """The format check of a kind; for the base kinds, the definition of a base span."""
    digits = F.length(_only(value, "0-9"))
    if name == "email":
        return F.lit(True)
    if name == "ip":

        def small(part):
            plain = F.regexp_replace(part, "^0+", "")
            return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))

        return F.forall(F.split(value, r"\."), small)
    if name == "card":
        return F.when(digits.between(13, 19), luhn(_only(value, "0-9"))).otherwise(False)
    if name == "phone":
        return digits.between(9, 15)
    if name == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    if name == "iban":
        return _mod97(value)
    return bind(F.regexp_extract(value, r"[A-Za-z0-9_/+.-]+$", 0), lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.length(v) >= 12))


def _bucket(value: Column, *bounds: int) -> Column:
    """Number of bounds that the value reaches."""
    return reduce(lambda a, b: a + b, [(value >= b).cast("int") for b in bounds])


def _candidate(name: str, value: Column, end: Column, before: Column, after: Column) -> Column:
    length = F.length(value)
    digits, letters = F.length(_only(value, "0-9")), F.length(_only(value, "A-Za-z"))
    own = before.rlike(f"(?i)(?:{WORDS[name]})")
    some = before.rlike("(?i)(?:" + "|".join(WORDS.values()) + ")")
    valid = F.coalesce(_check(name, value), F.lit(False))
    if name in EVIDENCE:  # key words are evidence here, so they are no features
        adverse = before.rlike(rf"(?is){OTHER_NUMBERS}(?!.*(?:{WORDS[name]}))")
        context, checked = F.lit(0), valid.cast("int")
        label = F.when(~valid | adverse, False).when(own, True)
    else:
        adverse, context, checked, label = F.lit(False), own.cast("int") + some.cast("int"), F.lit(0), valid
    return F.struct(
        F.lit(NAMES.index(name)).alias("kind"),
        (end - length).alias("start"),
        end.alias("end"),
        valid.alias("valid"),
        label.alias("label"),
        _bucket(length, 8, 12, 16, 20, 32).alias("length"),
        _bucket(digits, 1, 4, 9, 13, 20).alias("digits"),
        _bucket(letters, 1, 6, 12).alias("letters"),
        _bucket(length - digits - letters, 1, 2, 4).alias("others"),
        context.alias("context"),
        (before.rlike("[A-Za-z0-9]$").cast("int") + after.rlike("^[A-Za-z0-9]").cast("int")).alias("touched"),
        checked.alias("checked"),
        adverse.cast("int").alias("adverse"),
    )


def candidates(text: Column) -> Column:
    """All proposed spans of a text, as an array."""

    def of(name):
        pattern, test = KINDS[name]
        some = text.contains(test) if len(test) == 1 else text.rlike(test)
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        parts = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps"))
        if name == "iban":  # matches are heads, so that one never hides another; tails are looked at ahead
            parts = F.struct(*[parts[f].alias(f) for f in ("found", "gaps")], F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("tails"))

        def spans(p):
            lengths = F.transform(p.found, lambda m, i: F.length(F.get(p.gaps, i)) + F.length(m))
            return bind(
                running_sums(lengths),
                lambda ends: F.transform(p.found, lambda m, i: whole(p, m, i, F.get(ends, i))),
            )

        def whole(p, m, i, end):
            before, after = F.right(F.get(p.gaps, i), F.lit(32)), F.left(F.get(p.gaps, i + 1), F.lit(1))
            if name != "iban":
                return _candidate(name, m, end, before, after)
            # No letter or digit follows any of the ends.
            return bind(_iban(m, F.get(p.tails, i)), lambda v: _candidate(name, v, end - F.length(m) + F.length(v), before, F.lit("")))

        made = bind(parts, spans)
        return F.when(some, made).otherwise(F.array())

    return F.concat(*[of(name) for name in NAMES])


class Trees:
    """Boosted trees of two levels over integer features, and a threshold per kind."""

    def __init__(self, counts: list[tuple], rounds=24, rate=0.4, precision=PRECISION):
        """``counts``: (feature vector, labelled candidates, positive ones). Vectors without a label are left out."""
        self.trees: list[tuple] = []
        self.thresholds = {}
        rows = sorted(row for row in counts if row[1])
        self.learned = {f[0] for f, _, g in rows if g}
        if not rows:
            return
        total, good = sum(n for _, n, _ in rows), sum(g for _, _, g in rows)
        self.prior = math.log((good + 1) / (total - good + 1))
        scores = [self.prior] * len(rows)
        for _ in range(rounds):
            chance = [1 / (1 + math.exp(-s)) for s in scores]
            gradient = [g - n * p for (_, n, g), p in zip(rows, chance)]
            weight = [n * p * (1 - p) for (_, n, _), p in zip(rows, chance)]
            tree = self._grow(rows, gradient, weight, list(range(len(rows))), 2, rate)
            self.trees.append(tree)
            scores = [s + self._value(tree, f) for s, (f, _, _) in zip(scores, rows)]
        for kind in {f[0] for f, _, _ in rows}:
            ranked = sorted(((s, n, g) for s, (f, n, g) in zip(scores, rows) if f[0] == kind), reverse=True)
            seen = passed = 0
            for at, (s, n, g) in enumerate(ranked):
                seen, passed = seen + n, passed + g
                below = ranked[at + 1][0] if at + 1 < len(ranked) else s
                if (below < s or at + 1 == len(ranked)) and passed >= precision * seen:
                    self.thresholds[kind] = (s + below) / 2

    def _grow(self, rows, gradient, weight, own, depth, rate):
        g, w = sum(gradient[i] for i in own), sum(weight[i] for i in own)
        best = (1e-9, None)
        for feature in range(len(rows[0][0])) if depth else ():
            for bound in sorted({rows[i][0][feature] for i in own})[:-1]:
                left = [i for i in own if rows[i][0][feature] <= bound]
                gl, wl = sum(gradient[i] for i in left), sum(weight[i] for i in left)
                gain = gl**2 / (wl + 1) + (g - gl) ** 2 / (w - wl + 1) - g**2 / (w + 1)
                best = max(best, (gain, (feature, bound)), key=lambda b: b[0])
        if best[1] is None:
            return round(rate * g / (w + 1), 6)
        feature, bound = best[1]
        sides = [[i for i in own if (rows[i][0][feature] <= bound) is side] for side in (True, False)]
        return (feature, bound, *(self._grow(rows, gradient, weight, s, depth - 1, rate) for s in sides))

    def _value(self, tree, features):
        while isinstance(tree, tuple):
            tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, candidate: Column) -> Column:
        def of(tree):
            if not isinstance(tree, tuple):
                return F.lit(tree)
            return F.when(candidate[FEATURES[tree[0]]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        return reduce(lambda a, b: a + b, [of(t) for t in self.trees], F.lit(self.prior))

    def selects(self, candidate: Column) -> Column:
        """Whether the score reaches the kind's threshold."""
        chosen = F.lit(False)
        for kind, threshold in sorted(self.thresholds.items()):
            chosen = chosen | ((candidate["kind"] == kind) & (self.score(candidate) >= threshold - 1e-9))
        return chosen


def train(found: DataFrame, **options) -> Trees:
    """Trees from the counts of every distinct feature vector of all candidates (column ``found``)."""
    vectors = found.select(F.explode("found").alias("c")).groupBy(*[F.col(f"c.{f}").alias(f) for f in FEATURES])
    counts = vectors.agg(F.count("c.label").alias("n"), F.count_if("c.label").alias("g"))
    return Trees([(tuple(r[f] for f in FEATURES), r["n"], r["g"]) for r in counts.collect()], **options)


def select(found: Column, trees: Trees) -> Column:
    """The base spans and the selected others of an array of candidates, by kind, then start.

    A candidate of an added kind whose check proves is selected whatever the score if it passes: the thresholds are of the
    whole corpus, and one source of look-alikes must not hide what the other documents hold. Kinds labelled by evidence are
    selected by score alone once there is evidence to learn from.
    """
    base = F.filter(found, lambda c: (c["kind"] < BASE) & c["valid"])
    scored = [NAMES.index(name) for name in EVIDENCE if NAMES.index(name) in trees.learned]

    def with_base(held):
        free = lambda c: ~F.exists(held, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        passing = lambda c: (c["kind"] >= BASE) & c["valid"] & ~c["kind"].isin(scored)
        added = F.filter(found, lambda c: ~((c["kind"] < BASE) & c["valid"]) & (passing(c) | trees.selects(c)) & free(c))
        plain = lambda kept, is_base: F.transform(
            kept, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.lit(is_base).alias("base"))
        )
        return F.array_sort(F.concat(plain(held, True), plain(added, False)))

    return bind(base, with_base)


def spelled(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, NAMES)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def personal_spans(docs: DataFrame, text="text", spans="spans", **options) -> DataFrame:
    """``docs`` and an array column ``spans`` of structs (kind, start, end, base), in code points, end exclusive.

    A null or empty text has no spans; repeated rows have the same spans; an empty table gives no rows. A column
    of ``docs`` named like ``spans`` is replaced.
    """
    working = "_pii_candidates"
    found = settle(docs.withColumn(working, candidates(F.coalesce(F.col(text), F.lit("")))), "pii-candidates")
    trees = train(found.select(F.col(working).alias("found")), **options)
    return found.withColumn(spans, select(F.col(working), trees)).drop(working)


def redact(text: Column, spans: Column) -> Column:
    """The text with each selected span replaced by its kind in brackets. Overlapping spans are one, named by the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def join(acc, s):
        top = F.element_at(acc, -1)
        meets = (F.size(acc) > 0) & (s["start"] < top["end"])
        merged = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(top["start"].alias("start"), F.greatest(top["end"], s["end"]).alias("end"), top["kind"].alias("kind"))))
        return F.when(meets, merged).otherwise(F.concat(acc, F.array(s)))

    empty = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    label = lambda s: F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, NAMES)), s["kind"] + 1)), F.lit("]"))

    def apply(merged):
        ends = lambda i: F.when(i == 0, 0).otherwise(F.get(merged, i - 1)["end"])
        parts = F.transform(merged, lambda s, i: F.concat(F.substring(text, ends(i) + 1, s["start"] - ends(i)), label(s)))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(merged, -1)["end"] + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(bind(F.aggregate(ordered, empty, join), apply))
