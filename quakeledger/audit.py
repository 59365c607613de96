"""The whole audit: all catalogs in one plan, from canonical rows to verdicts."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeledger.operators import subtests as st
from quakeledger.operators.decision import Thresholds, audit_verdicts, documents
from quakeledger.operators.interval import long_form
from quakeledger.runtime import checkpoint, written


#: Tests of one audit that run at a time.
SIDE_BY_SIDE = 3


def _long(name: str, test: DataFrame) -> DataFrame:
    return long_form(test, name, F.col("score"), F.col("applicable"), F.col("n_used"))


@dataclass(frozen=True)
class Audit:
    """What an audit compares with: reference events (source_id, t, latitude, longitude, magnitude), fault points, settings."""

    references: DataFrame | None = None
    faults: DataFrame | None = None
    reference_dimension: float | None = None
    thresholds: Thresholds = Thresholds()

    def subtest_rows(self, cat: DataFrame, intrinsic: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
        """Long rows (catalog_id, test, score, applicable, n_used) of all sub-tests; A1-A5 on ``intrinsic``."""
        own = cat if intrinsic is None else intrinsic
        stats = checkpoint(st.row_stats(cat)) if stats is None else stats
        # Each test is a plan of its own that ends with a row for each catalog: in one plan for all of them, the driver would
        # hold the broadcasts, exchanges and plan texts of twenty tests at a time. What tests share is made once.
        tests = {
            "A1": lambda: st.a1_benford(own), "A3": lambda: st.a3_omori(own), "A4": lambda: st.a4_fractal(own, self.reference_dimension), "A5": lambda: st.a5_duplicates(own),
            "I4": lambda: st.i4_dedup(cat), "P7": lambda: st.p7_timestamps(cat), "C2": lambda: st.c2_mc_adequacy(cat), "C3": lambda: st.c3_coverage(cat), "C4": lambda: st.c4_strata(cat),
        }
        if self.faults is not None:
            tests["P8"] = lambda: st.p8_proximity(cat, self.faults)
        if intrinsic is not None:
            tests["A2"] = lambda: st.a2_gutenberg_richter(st.b_values(own))
        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            begin = lambda f: pool.submit(copy_context().run, f)
            begun = lambda tests: {name: begin(lambda name=name, f=f: checkpoint(_long(name, f()))) for name, f in tests.items()}
            shared = [begin(lambda: checkpoint(st.b_values(cat))), begin(lambda: st.magnitude_ranks(cat))]
            made = begun(tests)
            b, ranks = (x.result() for x in shared)
            made |= begun({"I1": lambda: st.i1_drift(cat, ranks), "I2": lambda: st.i2_clipping(cat, b), "I5": lambda: st.i5_ks(cat, ranks)})
            made = {name: x.result() for name, x in made.items()}
        # These only read what is there already.
        made |= {"P4": _long("P4", st.p4_tsunami(stats)), "C1": _long("C1", st.c1_missingness(stats)), "I3": _long("I3", st.i3_revision(stats))}
        made |= {p: _long(p, st.share_kept(stats, p.lower())) for p in ("P5", "P6", "P9")}
        if intrinsic is None:
            made["A2"] = _long("A2", st.a2_gutenberg_richter(b))
        out = None
        for rows in made.values():
            out = rows if out is None else out.unionByName(rows)
        if self.faults is None:
            out = out.unionByName(stats.select("catalog_id", F.lit("P8").alias("test"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("applicable"), F.lit(None).cast("long").alias("n_used")))
        # A catalog that a test says nothing about still has that test, as one that doesn't apply.
        names = F.array(*(F.lit(t) for t in sorted({*made, "P8"})))
        every = stats.select("catalog_id", F.explode(names).alias("test"))
        got = every.join(out, ["catalog_id", "test"], "left")
        return got.select("catalog_id", "test", "score", F.coalesce("applicable", F.lit(False)).alias("applicable"), "n_used")

    def verdicts(self, cat: DataFrame) -> DataFrame:
        """One row for each catalog (see audit_verdicts). The catalog is materialised once and read by all sub-tests."""
        return self._audited(cat)[0]

    def documents(self, cat: DataFrame) -> DataFrame:
        """(catalog_id, document): the verdicts with all that stands behind them (see decision.documents)."""
        verdicts, results, gates = self._audited(cat)
        return documents(verdicts, results, gates)

    def _audited(self, cat: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        cat = written(cat)
        a6 = intrinsic = None
        if self.references is not None:
            votes = checkpoint(st.source_votes(cat, self.references))
            a6 = checkpoint(st.a6_external(votes))
            intrinsic = written(cat.join(st.effective_records(votes, a6), ["catalog_id", "record_id"], "left_anti"))
        stats = checkpoint(st.row_stats(cat))
        results, gates = checkpoint(self.subtest_rows(cat, intrinsic, stats)), st.gates(stats)
        return audit_verdicts(results, stats.select("catalog_id", "n"), gates, a6, self.thresholds), results, gates
