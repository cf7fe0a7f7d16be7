"""Types of the relations."""

from __future__ import annotations

DOCUMENT = "path string, root string, raw_text string, skill string"
FIELD = "struct<line:int,value:string,snippet:string,in_code_block:boolean,field_source:string,key:string>"
#: what an operator says about a document; the rule adds the rest
SIGNAL = "struct<score:int,confidence:string,description:string,line:int,snippet:string>"
EVIDENCE = "struct<path:string,line:int,snippet:string>"
OVERRIDE = "struct<original:string,applied:string,reason:string>"
FINDING = (
    "id string, severity string, score int, confidence string, title string, description string, "
    f"evidence {EVIDENCE}, skill string, rule_id string, recommendation string, classification string, severity_override {OVERRIDE}"
)
CANDIDATE = (
    "struct<rule_id:string,internal_rule_id:string,score:int,confidence:string,title:string,description:string,"
    "path:string,line:int,snippet:string,recommendation:string,classification:string,seq:bigint>"
)
