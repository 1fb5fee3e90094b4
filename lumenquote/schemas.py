"""Row types of the data model; one answer of the library API is one row here."""

JUDGE_RESULT = "answer_id bigint, id string, class string, confidence double, reasons array<string>"
GATE_JOB = (
    "answer string, sources array<struct<id:string,title:string,url:string,text:string,extraTexts:array<string>>>, "
    "options struct<judge:boolean,thresholds:struct<minScore:double,minUncitedChars:int>>"
)

ENTAILMENT_CLASSES = ("entailed", "partially_entailed", "overstated", "insufficient", "contradicted")
