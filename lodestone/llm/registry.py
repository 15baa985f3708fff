"""The queries of this subpackage and their SQL; the pipeline of several is in corpus_pipeline."""

from __future__ import annotations

from lodestone.llm import audio, audit, bestfit, langid, licenses, packing, segmentation, simhash, substrings, surrogates, topk, toxicity, trie


def queries():
    return {
        "op1_langid": langid.op1_langid,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_simhash": simhash.op3_simhash,
        "op4_topk": topk.op4_topk,
        "op5_licenses": licenses.op5_licenses,
        "op6_packing": packing.op6_packing,
        "op7_surrogates": surrogates.op7_surrogates,
        "op8_segmentation": segmentation.op8_segmentation,
        "op9_substrings": substrings.op9_substrings,
        "op10_audio": audio.op10_audio,
        "op11_trie": trie.op11_trie,
        "op12_bestfit": bestfit.op12_bestfit,
        "op13_filters": audit.op13_filters,
    }


def oracle_sql():
    return {"op4_topk": topk.SQL, "op9_substrings": substrings.SQL, "op11_trie": trie.SQL, "op13_filters": audit.SQL}
