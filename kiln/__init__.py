"""kiln: post-training data jobs (scoring, group statistics, decontamination,
mixtures, curation, grading) expressed as Spark DataFrame plans.

Every public function takes and returns ``Column`` or ``DataFrame`` objects;
nothing in the library collects rows to the driver except bounded metadata
(per-partition counts, a checked-size broadcast decision).
"""

__version__ = "0.1.0"
