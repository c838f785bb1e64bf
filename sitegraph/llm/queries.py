"""Registered queries of the training-data operators."""

from __future__ import annotations

from sitegraph.llm.decontamination import SQL as DECONTAMINATION, op10_decontamination
from sitegraph.llm.fingerprints import op6_multiset_fingerprints
from sitegraph.llm.hard_negatives import SQL as HARD_NEGATIVES, op11_hard_negatives
from sitegraph.llm.html_text import op5_main_text
from sitegraph.llm.licenses import op4_license_scan
from sitegraph.llm.merkle import SQL as MERKLE, op12_merkle_manifest
from sitegraph.llm.ngram_join import op2_ngram_join
from sitegraph.llm.packing import op7_best_fit_packing
from sitegraph.llm.private_data import op13_private_data
from sitegraph.llm.secrets import op1_secret_scan
from sitegraph.llm.sharding import SQL as SHARDS, op8_stratified_shards
from sitegraph.llm.toxicity import op9_toxicity
from sitegraph.llm.warc import op3_warc_archives

QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_ngram_join, op3_warc_archives, op4_license_scan, op5_main_text, op6_multiset_fingerprints,
    op7_best_fit_packing, op8_stratified_shards, op9_toxicity, op10_decontamination, op11_hard_negatives,
    op12_merkle_manifest, op13_private_data)}
#: The other operators have no oracle; tests/llm checks each against a brute-force version.
ORACLE: dict[str, str] = {
    "op8_stratified_shards": SHARDS, "op10_decontamination": DECONTAMINATION, "op11_hard_negatives": HARD_NEGATIVES, "op12_merkle_manifest": MERKLE}
