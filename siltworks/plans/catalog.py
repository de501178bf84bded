"""Every query of the core and, where SQL can say it, the SQL that must give the same rows."""

from __future__ import annotations

from siltworks.plans import corpus, datasets, dialogue, reports

QUERIES = {**corpus.QUERIES, **dialogue.QUERIES, **reports.QUERIES, **datasets.QUERIES}
ORACLE: dict[str, str] = {**corpus.ORACLE, **dialogue.ORACLE, **reports.ORACLE, **datasets.ORACLE}
