"""The corpus pipeline's stages and its run; they live with the operators that they call."""

from lakescreen.llm.pipeline import ORACLE_SQL, STAGES, drop_leaks, drop_near_duplicates, drop_toxic, mask_personal_data, mix_sources, run

__all__ = ["ORACLE_SQL", "STAGES", "drop_leaks", "drop_near_duplicates", "drop_toxic", "mask_personal_data", "mix_sources", "run"]
