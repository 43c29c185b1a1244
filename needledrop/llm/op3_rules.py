"""Quality rules as a learned decision list.

Statistics of every text are array and string expressions. Rules for low quality are found
by sequential covering over labelled statistics: a conjunction of thresholds grows by FOIL
gain on one part of the rows, is pruned on the other, and the rows that it covers leave. The
list becomes one ordered ``when`` expression. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needledrop.scratch import materialise

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ratios() -> dict[str, Column]:
    """The ratios on which rules may set thresholds; null where a text has no word or line."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.try_divide("word_chars", "n_words"),
        "symbols": F.try_divide("n_symbols", "n_words"),
        "duplicate_lines": F.try_divide("n_dup_lines", "n_lines"),
        "repeated_words": F.try_divide("n_repeat_words", "n_words"),
        "upper_case": F.try_divide("n_upper", "word_chars"),
        "exclamations": F.try_divide("n_exclamations", "n_words"),
    }


def without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id with the counts of the module's contract and a few more, all long.

    Words are runs outside space and \\x09-\\x0D. A null or empty text has no words and zero counts.
    Equal word triples meet by the upper bits of a hash, sorted together with their places, and count
    where the whole 64-bit hash and the three words are equal.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(HAS_WORD))
    df = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.array_remove(F.split("text", SPACES, -1), "").alias("words"), lines.alias("lines"),
    )
    triples = F.slice(F.transform("words", lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2))), 1, F.greatest(F.size("words") - 2, F.lit(0)))
    df = df.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        without(F.col("text"), SPACE).cast("bigint").alias("word_chars"),
        (F.length("text") - without(F.col("text"), SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.length("text") - without(F.col("text"), UPPER)).cast("bigint").alias("n_upper"),
        (F.length("text") - without(F.col("text"), "!")).cast("bigint").alias("n_exclamations"),
        "words",
        triples.alias("triples"),
    )
    bits = F.ceil(F.log2(F.size("triples") + 1)).cast("int")
    df = df.withColumn("bits", F.when(F.size("triples") > F.size(F.array_distinct("triples")), bits))
    packed = F.sort_array(F.transform("triples", lambda h, i: F.call_function("shiftleft", h, F.col("bits")).bitwiseOR(i.cast("bigint"))))
    df = df.withColumn("packed", F.when(F.col("bits").isNotNull(), packed))

    def same(v: Column, at: Column) -> Column:
        return F.coalesce(F.call_function("shiftright", v, F.col("bits")) == F.call_function("shiftright", F.get("packed", at), F.col("bits")), F.lit(False))

    near = F.filter("packed", lambda v, i: same(v, i - 1) | same(v, i + 1))
    place = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bits")) - 1
    # few are left: these are told apart by the whole hash and then by their words
    df = df.withColumn("near", F.sort_array(F.transform(near, lambda v: F.struct(F.get("triples", v.bitwiseAND(place).cast("int")).alias("h"), v.bitwiseAND(place).cast("int").alias("at")))))

    def equal(v: Column, other: Column) -> Column:
        words = [F.get("words", v["at"] + k) == F.get("words", other["at"] + k) for k in range(3)]
        return F.coalesce((v["h"] == other["h"]) & words[0] & words[1] & words[2], F.lit(False))

    repeated = F.filter("near", lambda v, i: equal(v, F.get("near", i - 1)) | equal(v, F.get("near", i + 1)))
    df = df.withColumn("places", F.sort_array(F.transform(repeated, lambda v: v["at"].cast("bigint"))))
    gaps = F.transform("places", lambda x, i: F.least(F.lit(3).cast("bigint"), F.coalesce(F.get("places", i + 1) - x, F.lit(3).cast("bigint"))))
    covered = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("words", "triples", "bits", "packed", "near", "places")


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.coalesce(F.col(self.name) > self.threshold if self.above else F.col(self.name) <= self.threshold, F.lit(False))

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def learn_list(labelled: DataFrame, names: list[str], thresholds: int = 48, max_rules: int = 8, max_conditions: int = 3, least_rows: int = 3) -> list[list[Condition]]:
    """Conjunctions that mark rows with ``bad``; empty where a class has no row.

    ``labelled`` has the named doubles and boolean ``bad``. Each step is one aggregation over all
    labelled rows; names x thresholds counts reach the driver. A third of the rows, by a hash of
    their values, prunes.
    """
    probabilities = [(i + 1) / (thresholds + 1) for i in range(thresholds)]
    cuts = {n: sorted(set(c)) for n, c in zip(names, labelled.approxQuantile(names, probabilities, 0.002), strict=True)}
    bad = labelled.filter("bad")
    for n, c in zip(names, bad.approxQuantile(names, probabilities, 0.002), strict=True):
        cuts[n] = sorted({*cuts[n], *c})
    names = [n for n in names if cuts[n]]
    rows = labelled.withColumn("prune", F.pmod(F.xxhash64(*names), F.lit(3)) == 0) if names else labelled
    rules: list[list[Condition]] = []

    def cuts_below(name: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts[name])), lambda t: F.col(name) > t))

    def counts(df: DataFrame) -> dict[str, dict[int, list[int]]]:
        """name -> bin -> [bad, good]; a value above k cuts is in bin k; null values are in none."""
        cells = [F.struct(F.lit(n).alias("name"), cuts_below(n).alias("bin"), F.col(n).isNotNull().alias("known")) for n in names]
        found = df.select("bad", F.inline(F.array(*cells))).filter("known").groupBy("name", "bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
        out: dict[str, dict[int, list[int]]] = {n: {} for n in names}
        for r in found:
            out[r["name"]][r["bin"]] = [r["p"], r["n"]]
        return out

    while names and len(rules) < max_rules:
        rest = rows
        for rule in rules:
            rest = rest.filter(~_all(rule))
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            table = counts(rest.filter(~F.col("prune") & _all(rule)))
            p0, n0 = (sum(x[i] for x in max(table.values(), key=lambda t: sum(x[0] + x[1] for x in t.values())).values()) for i in (0, 1))
            if p0 < least_rows or n0 == 0:
                break
            best = (0.0, None)
            for name, bins in table.items():
                total = [sum(x[i] for x in bins.values()) for i in (0, 1)]
                low = [0, 0]
                for k, cut in enumerate(cuts[name]):
                    low = [low[i] + bins.get(k, [0, 0])[i] for i in (0, 1)]
                    for above, (p, n) in ((False, low), (True, [total[0] - low[0], total[1] - low[1]])):
                        if p >= least_rows:
                            gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-9:
                                best = (gain, Condition(name, above, cut))
            if best[1] is None:
                break
            rule = [*rule, best[1]]
        if not rule:
            break
        kept = rest.filter("prune")
        tried = [_all(rule[:k]) for k in range(1, len(rule) + 1)]
        seen = kept.agg(*[F.count_if(c & (F.col("bad") == good)).alias(f"{side}{k}") for k, c in enumerate(tried) for side, good in (("p", True), ("n", False))]).first()
        worth = [((seen[f"p{k}"] - seen[f"n{k}"]) / (seen[f"p{k}"] + seen[f"n{k}"]) if seen[f"p{k}"] + seen[f"n{k}"] else -1.0) for k in range(len(rule))]
        k = max(range(len(rule)), key=lambda i: (worth[i], -i))
        if worth[k] <= 0.2:
            break
        rules.append(rule[: k + 1])
    return rules


def as_expression(rules: list[list[Condition]]) -> Column:
    """The ordered list as one conditional expression: false where a rule fits, else true."""
    out = None
    for rule in rules:
        out = F.when(_all(rule), False) if out is None else out.when(_all(rule), False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge_quality(docs: DataFrame, labels: DataFrame, **learning) -> DataFrame:
    """Per document: the counts, base_failed, and kept by the base rules and the learned list.

    ``labels`` has doc_id and quality; null or unknown ids and other qualities teach nothing, and
    without both classes the list is empty. Repeated rows and ids are judged row by row; an empty
    table gives none; further columns are ignored.
    """
    stats = materialise(text_statistics(docs))
    names = list(ratios())
    known = labels.filter("quality in (0, 1)").select(F.col("doc_id").alias("labelled"), (F.col("quality") == 0).alias("bad"))
    labelled = materialise(stats.join(known, F.col("doc_id") == F.col("labelled")).select("bad", *[c.alias(n) for n, c in ratios().items()]))
    both = labelled.agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).first()
    rules = learn_list(labelled, names, **learning) if both["bad"] and both["good"] else []
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = stats.withColumns(ratios()).withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & as_expression(rules))
    return out.withColumn("rules", F.lit("; ".join(" and ".join(map(str, r)) for r in rules))).drop(*names)
