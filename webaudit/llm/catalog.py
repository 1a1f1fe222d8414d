"""The queries of this subpackage, and the SQL that checks them where SQL can."""

from __future__ import annotations

from . import ann, conversation, decontamination, langid, media, ngram_join, packing, pieces, pii, secret_scan, sharding, spelling, warc

QUERIES = {
    "op6_pii": pii.op6_pii,
    "op9_pieces": pieces.op9_pieces,
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op8_langid": langid.op8_langid,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_ann": ann.op3_ann,
    "op4_warc": warc.op4_warc,
    "op5_packing": packing.op5_packing,
    "op7_sharding": sharding.op7_sharding,
    "op10_media": media.op10_media,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_spelling": spelling.op12_spelling,
    "op13_conversation": conversation.op13_conversation,
}
SQL = {
    "op3_ann": ann.SQL,
    "op4_warc": warc.SQL,
    "op11_decontamination": decontamination.SQL,
    "op12_spelling": spelling.SQL,
}
