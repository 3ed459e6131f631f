"""The registered queries of the operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewarden.llm.decontamination import op4_decontamination
from pagewarden.llm.divergence import OP12_SQL, op12_divergence
from pagewarden.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from pagewarden.llm.licenses import op3_licenses
from pagewarden.llm.lm import op5_lm_scores
from pagewarden.llm.near_dedup import op9_near_dedup
from pagewarden.llm.packing import op10_packing
from pagewarden.llm.pii import op13_personal_data
from pagewarden.llm.quality import op7_quality
from pagewarden.llm.quotations import op1_quotations
from pagewarden.llm.resampling import OP11_SQL, op11_resampling
from pagewarden.llm.secrets import op2_secrets
from pagewarden.llm.token_files import op8_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quotations, op2_secrets, op3_licenses, op4_decontamination, op5_lm_scores, op6_exact_dedup, op7_quality, op8_token_files, op9_near_dedup, op10_packing, op11_resampling, op12_divergence, op13_personal_data)
}
SQL: dict[str, str] = {"op6_exact_dedup": OP6_SQL, "op11_resampling": OP11_SQL, "op12_divergence": OP12_SQL}
