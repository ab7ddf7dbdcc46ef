"""Explicit schemas of the label layouts and the canonical box table."""

from __future__ import annotations

PAGE_WIDTH = 2480
PAGE_HEIGHT = 3508

# The label vocabulary of the annotation tool.
LABELS = [
    "Order number", "Shipping line", "Case mark", "Item number", "Part number", "Delivery date", "Quantity",
    "Unit price", "Line total", "Net amount (total)", "Part description",
]

BOX = "struct<x:bigint,y:bigint,width:bigint,height:bigint>"

GROUPED = "file_name string, class string, items array<struct<group_id:string,labels:array<struct<label:string,text:string,bbox:array<bigint>>>>>"

REGIONS = (
    "file_name string, document_type string, pages array<struct<page_number:bigint,"
    f"regions:array<struct<label:string,text:string,bbox:array<bigint>,confidence:double>>>>"
)

FLAT = (
    "filename string, filepath string, pageNumber bigint, class string, "
    "bboxes array<struct<x:bigint,y:bigint,width:bigint,height:bigint,label:string,text:string,group_id:string,"
    "ocr_original:string,ocr_confidence:double,was_corrected:boolean>>, "
    "items array<struct<group_id:string,type:string,y_position:bigint,item_number:string,labels:array<struct<"
    "label:string,text:string,bbox:array<bigint>,ocr_original:string,ocr_confidence:double,was_corrected:boolean>>>>, "
    "total_groups bigint, "
    "group_summary struct<total_items:bigint,total_headers:bigint,total_summaries:bigint,item_numbers:array<string>>"
)

ENTITY = (
    "annotation_version string, "
    "document_metadata struct<filename:string,filepath:string,pageNumber:bigint,document_type:string,"
    "document_class:string,template_id:string,language:string,ocr_engine:string,ocr_confidence:double>, "
    "page_info struct<width:bigint,height:bigint,dpi:bigint>, "
    "layout_analysis struct<layout_pattern:string,layout_confidence:double>, "
    f"entities array<struct<entity_id:string,bbox:{BOX},"
    "text:struct<value:string,confidence:double>,label:struct<primary:string,confidence:double>,"
    "ocr_results:struct<tesseract_raw:string,tesseract_confidence:double,corrected_value:string,was_corrected:boolean>>>, "
    "quality_metrics struct<overall_confidence:double,completeness:double,consistency:double>"
)

WORDS = f"file_name string, page bigint, words array<struct<text:string,confidence:double,bbox:{BOX}>>"

FEEDBACK = (
    "document_id string, user_id string, feedback_timestamp string, reviewed_annotations array<struct<"
    "annotation_id:string,document_id:string,page_number:bigint,annotation_type:string,annotation_status:string,"
    f"bounding_boxes:array<struct<x:bigint,y:bigint,width:bigint,height:bigint,page_number:bigint,confidence_score:double>>,"
    "text_value:string,confidence_score:double>>"
)

DATASET_ITEM = (
    "document_id string, status string, document_type string, "
    f"annotations array<struct<field_name:string,bounding_box:{BOX},text_value:string,confidence_score:double>>"
)

ENTITY_COLUMNS = [
    "doc_id", "page_number", "entity_seq", "label", "text", "x", "y", "width", "height", "group_id", "ocr_original",
    "ocr_confidence", "was_corrected",
]
