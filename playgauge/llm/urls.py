"""URL filters: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

A rule names a host and a beginning of the path, like ``example.net/en/``. It fits that host and all its
subdomains where the URL's path begins with the rule's; the longest rule that fits decides. Without a rule the
vocabulary does: all terms are looked up at once in host and path, a hit counts only where no letter or digit
adjoins it, and a URL is rejected on one strict term or on ``soft_hits`` different soft ones. Terms may also have
points of their own, as from a table (``Vocabulary.of_table``).

Nulls and unusual input: a null URL, or one without ``://``, has an empty host and path, no rule and no
terms, and is allowed. A long host or path is read once. Repeated rows are judged alike; an empty table gives an empty
result. Further columns pass through; ones named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playgauge.llm.common import worker_state

#: The rules of the registered query.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
STRICT = ("casino", "porn", "xxx", "warez", "viagra", "phishing", "malware", "torrent", "escort", "keygen")
SOFT = ("adult", "bet", "bonus", "cheap", "crack", "dating", "download", "free", "jackpot", "loan", "nude", "pills", "poker", "prize", "sex", "slots", "win")
#: Rules and terms go to every task, so their number is bounded.
MOST_RULES = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Vocabulary:
    """Terms, lower-case ASCII. One strict term rejects, and so do ``soft_hits`` different soft ones.

    A soft term is a point and a strict one ``soft_hits`` of them; ``pointed`` terms have points of their own, negative
    ones too. Points of different terms add up.
    """

    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    soft_hits: int = 2
    pointed: tuple[tuple[str, int], ...] = ()

    @classmethod
    def of_table(cls, terms: DataFrame, enough: int) -> Vocabulary:
        """A vocabulary of the rows' ``term`` and ``points``, which reject from ``enough`` points on; nulls and empty terms are left out."""
        known = terms.where("term <> '' AND points IS NOT NULL").groupBy(F.translate("term", UPPER, LOWER).alias("term"))
        rows = known.agg(F.max("points").cast("int").alias("points")).limit(MOST_RULES + 1).collect()  # checked below
        if len(rows) > MOST_RULES:
            raise ValueError(f"at most {MOST_RULES} terms")
        return cls((), (), enough, tuple(sorted((r["term"], r["points"]) for r in rows)))

    def __len__(self) -> int:
        return len(self.strict) + len(self.soft) + len(self.pointed)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        points = dict.fromkeys(self.soft, 1) | dict.fromkeys(self.strict, self.soft_hits) | dict(self.pointed)
        for term, n in points.items():
            found.add_word(term, (term, n))
        if len(found):
            found.make_automaton()
        return found

    def rejects(self, automaton: ahocorasick.Automaton, text: str) -> bool:
        met: dict[str, int] = {}
        if not len(automaton):
            return False
        for end, (term, points) in automaton.iter(text):
            before = end - len(term)
            if (before >= 0 and _joins(text[before])) or (end + 1 < len(text) and _joins(text[end + 1])):
                continue
            met[term] = points
        return bool(met) and sum(met.values()) >= self.soft_hits


def _joins(sign: str) -> bool:
    return sign.isascii() and sign.isalnum()


def parts(url: str = "url"):
    """Host (A-Z lower-cased) and path of a URL, both empty without ``://``."""
    link = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.when(F.instr(link, "://") > 0, F.expr(f"substr({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def filtered(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    vocabulary: Vocabulary = Vocabulary(),
    url: str = "url",
) -> DataFrame:
    """The rows with ``host``, ``path``, ``rule`` and ``verdict`` (allow or block)."""
    if len(rules) > MOST_RULES or len(vocabulary) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules and terms")
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, slash, path = rule.partition("/")
        by_host.setdefault(host, []).append((slash + path, rule, verdict))

    longest = max(map(len, by_host), default=0)

    def decide(host: str, path: str, automaton: ahocorasick.Automaton) -> tuple[str | None, str]:
        best = None
        # Only what is left of the host from some label on, and no longer than a rule's, can be a rule's host.
        at = 0 if len(host) <= longest else host.find(".", len(host) - longest - 1) + 1 or -1
        while at >= 0:
            for start, rule, verdict in by_host.get(host[at:], ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        if best:
            return best
        text = f"{host}{path}".translate(str.maketrans(UPPER, LOWER))
        return None, "block" if vocabulary.rejects(automaton, text) else "allow"

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        kept = worker_state()
        if vocabulary not in kept:
            kept[vocabulary] = vocabulary.automaton()
        for hosts, paths in batches:
            rows = [decide(h, p, kept[vocabulary]) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(rows, columns=["rule", "verdict"])

    host, path = parts(url)
    out = pages.withColumns({"host": host, "path": path})
    return out.withColumn("_judged", judge("host", "path")).withColumns(
        {"rule": F.col("_judged.rule"), "verdict": F.col("_judged.verdict")}
    ).drop("_judged")
