"""Public suffixes and registrable domains by the published algorithm, as Column expressions.

A list of rules in the published text form is a parameter: names, `*.name` for every
label below a name, `!name` for an exception. Rules become sets of literals by kind,
so a host's longest match is a handful of set lookups on the labels from the right,
inside the scan, without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from siftgrid.functions.text import bound

#: A list has at most so many rules.
MOST_RULES = 50_000


@dataclass(frozen=True)
class Suffixes:
    """Rules by kind; names without their marks."""

    plain: frozenset[str]
    wild: frozenset[str]
    exceptions: frozenset[str]
    unknown_too: bool = True

    @classmethod
    def of(cls, lines: list[str], unknown_too: bool = True) -> Suffixes:
        """From the lines of a list: comments begin with //, a rule ends at white space. With unknown_too the last label of any other host is a suffix."""
        rules = [line.split()[0].lower() for line in lines if line.strip() and not line.strip().startswith("//")]
        return cls(
            frozenset(r for r in rules if r[0] not in "*!"), frozenset(r[2:] for r in rules if r.startswith("*.")), frozenset(r[1:] for r in rules if r[0] == "!"), unknown_too
        )

    @classmethod
    def read(cls, spark: SparkSession, path: str, unknown_too: bool = True) -> Suffixes:
        lines = [r[0] for r in spark.read.text(path).limit(MOST_RULES + 1).collect()]
        if len(lines) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} lines in {path}")
        return cls.of(lines, unknown_too)

    def labels(self, parts: Column) -> Column:
        """How many of a host's parts, from the right, are its public suffix; 0 if none is known."""
        most = max((r.count(".") + 1 for r in self.plain | self.wild | self.exceptions), default=1) + 1
        by_depth = lambda names: {k: sorted(n for n in names if n.count(".") + 1 == k) for k in range(1, most + 1)}
        plain, wild, exceptions = map(by_depth, (self.plain, self.wild, self.exceptions))

        def chosen(tails: Column) -> Column:
            # tails[k - 1] has the last k parts; there are as many as the host has, `most` at most.
            tail = lambda k: F.get(tails, F.lit(k - 1))
            out = F.when(tails.isNull(), F.lit(None).cast("int"))
            # An exception beats all, and its suffix is a label shorter; then the rule of most labels.
            for k in range(most, 0, -1):
                if exceptions[k]:
                    out = out.when(tail(k).isin(exceptions[k]), k - 1)
            for k in range(most, 0, -1):
                if plain[k]:
                    out = out.when(tail(k).isin(plain[k]), k)
                if k > 1 and wild[k - 1]:
                    out = out.when(tail(k).isNotNull() & tail(k - 1).isin(wild[k - 1]), k)
            return out.otherwise(1 if self.unknown_too else 0)

        numbers = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most)))
        return bound(F.transform(numbers, lambda k: last_parts(parts, k)), chosen)

    def suffix(self, host: Column) -> Column:
        return bound(F.split(F.lower(host), r"\.", -1), lambda parts: bound(self.labels(parts), lambda k: F.when(k > 0, last_parts(parts, k))))

    def registrable(self, host: Column) -> Column:
        """The public suffix and the label before it; null for a suffix itself, an empty label, or no known suffix."""

        def of(parts: Column) -> Column:
            return bound(self.labels(parts), lambda k: F.when((k > 0) & (F.size(parts) > k) & ~F.array_contains(parts, ""), last_parts(parts, k + 1)))

        return bound(F.split(F.lower(host), r"\.", -1), of)


def last_parts(parts: Column, k: Column) -> Column:
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - k + 1, F.lit(1)), k), ".")


# Common suffixes. A full list is read with Suffixes.read.
COMMON = (
    "com net org edu gov mil int info biz name io ai app dev co me tv xyz site online shop store tech cloud blog page eu us uk ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk police.uk sch.uk "
    "jp ac.jp co.jp go.jp ne.jp or.jp kyoto.jp ide.kyoto.jp *.kawasaki.jp *.kobe.jp !city.kawasaki.jp !city.kobe.jp au com.au net.au org.au edu.au gov.au nz co.nz org.nz br com.br net.br org.br in co.in org.in "
    "za co.za org.za mx com.mx sg com.sg cn com.cn net.cn org.cn tw com.tw hk com.hk kr co.kr il co.il tr com.tr ar com.ar pl com.pl de fr es it nl be ch at se no dk fi ie pt ru ua com.ua "
    "ca ac ck *.ck !www.ck mm *.mm bd *.bd er *.er np *.np ak.us k12.ak.us uk.com local localhost test example invalid"
).split()
DEFAULT = Suffixes.of(COMMON)


def registrable(host: Column, suffixes: Suffixes = DEFAULT) -> Column:
    """The registrable domain of a host; a host that has none (an address, a suffix, a bare name) stands for itself."""

    def of(h: Column) -> Column:
        return F.when(h.contains(":") | h.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), h).otherwise(F.coalesce(suffixes.registrable(h), h))

    return bound(F.lower(host), of)
