"""Operations of a training-data pipeline. Nothing else in the package imports these modules."""

from millrace.llm import chat_pairs, exact, icws, langid, line_spread, mixing, piece_codec, repeats, secret_forest, winnow


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            piece_codec.op1_sentencepiece,
            winnow.op2_fingerprints,
            chat_pairs.op3_chat_preferences,
            line_spread.op4_line_spread,
            secret_forest.op5_secret_scan,
            icws.op6_near_dedup,
            mixing.op7_source_mixing,
            langid.op8_language_id,
            repeats.op9_suffix_dedup,
            exact.op10_exact_dedup,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_preferences": chat_pairs.ORACLE, "op4_line_spread": line_spread.ORACLE, "op10_exact_dedup": exact.ORACLE}
