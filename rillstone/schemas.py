"""Schemas of the record families; readers take them, so nothing is inferred."""

from __future__ import annotations

CARD = "STRUCT<id:STRING,content:STRING>"
EIL = (
    "id STRING, mechanism STRING, family_domain STRING, subscenario STRING, split STRING, user_natural_language STRING, adversary_opening STRING, "
    f"necessary_information ARRAY<{CARD}>, exploitable_slots ARRAY<STRUCT<id:STRING,content:STRING,severity:STRING>>, "
    "adversary_config STRUCT<strategy:STRING,tactics:ARRAY<STRING>,pressure:STRING>, meta STRUCT<num_nec:INT,num_exp:INT,nl_len:INT,synthesis_seed:DECIMAL(20,0)>"
)
MIU = (
    "id STRING, mechanism STRING, family_domain STRING, subscenario STRING, split STRING, user_natural_language STRING, "
    f"user_constraints ARRAY<STRUCT<id:STRING,type:STRING,content:STRING>>, user_preferences ARRAY<{CARD}>, authorized_information ARRAY<STRUCT<id:STRING,name:STRING,authority:STRING>>, "
    "decision_boundary STRUCT<options:ARRAY<STRUCT<id:STRING,label:STRING>>>, clean_context ARRAY<STRUCT<id:STRING,content:STRING,authorized_by:STRING>>, manipulated_context ARRAY<STRUCT<id:STRING,content:STRING,attack:STRING>>, "
    "external_information ARRAY<STRUCT<content:STRING>>, baseline_decision STRUCT<decision:STRING,grounded_on:ARRAY<STRING>,conclusion:STRING>, schema_notes STRING, "
    "meta STRUCT<num_conditions:INT,num_preferences:INT,num_auth:INT,num_clean:INT,num_mani:INT,num_options:INT,ext_len:INT,synthesis_seed:DECIMAL(20,0),external_information_order:ARRAY<STRING>,attack_version:INT>"
)
MESSAGES = "ARRAY<STRUCT<role:STRING,content:STRING>>"
#: Judge outputs come as JSON text.
JUDGES = {
    "adversary": "STRUCT<inferred_private_facts:ARRAY<STRUCT<info:STRING,basis:STRING,confidence:STRING>>,counterparty_reply:STRING>",
    "leakage": "STRUCT<slot_scores:ARRAY<STRUCT<slot_id:STRING,severity_score:DOUBLE,source:STRING,reply_evidence:STRING,inference_id:STRING>>>",
    "utility": "STRUCT<utility_score:DOUBLE,agent_reply_evidence:STRING,counterparty_reply_evidence:STRING>",
    "faithfulness": "STRUCT<claims:ARRAY<STRUCT<reason_id:STRING,response_quote:STRING,status:STRING,support_score:INT>>>",
}
