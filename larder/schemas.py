"""Explicit schemas (DDL); production reads never infer."""

from __future__ import annotations


PREDICTION = (
    "id long, barcode string, server_type string, type string, value_tag string, value string, "
    "source_image string, automatic_processing boolean, predictor string, predictor_version string, "
    "confidence double, timestamp timestamp, data string"
)

INSIGHT = (
    "id string, barcode string, server_type string, type string, value_tag string, value string, "
    "source_image string, automatic_processing boolean, predictor string, predictor_version string, "
    "confidence double, timestamp timestamp, data string, completed_at timestamp, annotation int, "
    "annotated_result int, n_votes int, username string, countries array<string>, brands array<string>, "
    "process_after timestamp, unique_scans_n int, reserved_barcode boolean, campaign array<string>, "
    "bounding_box array<double>, lc array<string>, with_image boolean"
)

IMAGE_META = (
    "struct<imgid:string,rev:string,angle:string,uploaded_t:string,x1:string,y1:string,x2:string,y2:string,"
    "sizes:map<string,struct<w:int,h:int>>>"
)

PRODUCT = (
    "code string, lang string, product_name string, countries_tags array<string>, categories_tags array<string>, "
    "emb_codes_tags array<string>, labels_tags array<string>, brands_tags array<string>, "
    "stores_tags array<string>, states_tags array<string>, quantity string, expiration_date string, "
    "unique_scans_n int, last_modified_t long, packagings array<struct<shape:string,material:string,recycling:string>>, "
    "ingredients_text string, ingredients_text_en string, ingredients_text_fr string, ingredients_text_de string, "
    f"serving_size string, schema_version int, images map<string,{IMAGE_META}>, "
    "nutrition struct<aggregated_set:struct<nutrients:map<string,struct<value:double,unit:string>>>,"
    "input_sets:array<struct<nutrients:map<string,struct<value:string,unit:string>>,per:string,"
    "preparation:string,source:string>>>"
)

DETECTION = (
    "barcode string, image_id string, result array<struct<score:double,bounding_box:array<double>,label:string>>"
)

TAXONOMY_NODE = (
    "struct<names:map<string,string>,synonyms:map<string,array<string>>,parents:array<string>,"
    "properties:map<string,string>>"
)

_VERTEX = "struct<vertices:array<struct<x:double,y:double>>>"
_WORD = (
    "struct<property:struct<detectedLanguages:array<struct<languageCode:string,confidence:double>>>,"
    f"boundingBox:{_VERTEX},symbols:array<struct<text:string,property:struct<detectedBreak:struct<type:string>>>>>"
)
OCR_CONTENT = (
    "struct<responses:array<struct<"
    "error:struct<code:int,message:string>,"
    "fullTextAnnotation:struct<text:string,pages:array<struct<width:int,height:int,"
    f"blocks:array<struct<paragraphs:array<struct<words:array<{_WORD}>>>>>>>>,"
    "textAnnotations:array<struct<description:string,locale:string>>,"
    "logoAnnotations:array<struct<mid:string,description:string,score:double>>,"
    "labelAnnotations:array<struct<mid:string,description:string,score:double>>,"
    "safeSearchAnnotation:struct<adult:string,spoof:string,medical:string,violence:string,racy:string>,"
    "faceAnnotations:array<struct<detectionConfidence:double>>>>>"
)
OCR_ROW = (f"source string, content {OCR_CONTENT}, created_at double")

PRODUCT_UPDATE = (
    "id string, stream string, timestamp timestamp, code string, flavor string, user_id string, "
    "action string, product_type string, comment string, diffs string"
)
OCR_READY = (
    "id string, stream string, timestamp timestamp, code string, product_type string, image_id string, json_url string"
)
DIFFS = (
    "fields struct<change:array<string>,add:array<string>,delete:array<string>>, "
    "uploaded_images struct<add:array<string>,delete:array<string>>, nutriments string, nutrition string, product_type string"
)
