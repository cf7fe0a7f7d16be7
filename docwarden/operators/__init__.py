"""Detection operators by strategy: each turns a rule into a column of signals of a parsed document."""

from __future__ import annotations

from docwarden.operators import fields, python, texts

#: strategy -> (rule, config) -> array of signals; the other strategies look across documents, see docwarden.plans.across
LOCAL = {
    "url_domain_filter": fields.url_domain_filter,
    "ip_address_scan": fields.ip_address_scan,
    "entropy_check": fields.entropy_check,
    "key_pattern_match": fields.key_pattern_match,
    "field_pattern_match": fields.field_pattern_match,
    "token_scan": fields.token_scan,
    "data_sensitivity_check": fields.data_sensitivity_check,
    "hint_count": texts.hint_count,
    "keyword_in_text": texts.keyword_in_text,
    "frontmatter_check": texts.frontmatter_check,
    "remote_reference_scan": texts.remote_reference_scan,
    "hidden_instruction_scan": python.of_rule,
    "bidi_control_scan": python.of_rule,
    "payload_decode_scan": python.of_rule,
    "confusable_identifier_scan": python.of_rule,
}
ACROSS = ("typosquat_check", "bundled_scripts_check")
