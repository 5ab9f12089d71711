"""Row types of screening."""

from pyspark.sql import types as T

SHIPMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "description", "origin_country", "destination_country", "consignee", "shipper")]
    + [T.StructField("declared_value", T.DoubleType()), T.StructField("declared_currency", T.StringType()), T.StructField("hs_code", T.StringType()), T.StructField("weight_kg", T.DoubleType())]
    + [T.StructField("transit_countries", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in ("country_of_manufacture", "final_destination", "incoterms")]
    + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)
COUNTRY = "country_code string, country_name string, overall_risk string, overall_score double, sanctions_status string, fatf_status string, transshipment_hub boolean, sanctioned_neighbors array<string>"
TAXONOMY = "group_id string, name string, risk_level string, allow_auto_clear boolean, semantic_phrases array<string>, hard_keywords array<string>"
PARTY = "name string, aliases array<string>, country string, list_name string"
HIT = "struct<group_id:string,group_name:string,risk_level:string,matched_phrase:string,matched_keyword:string,similarity_score:double>"
MATCH = "struct<matched_party:string,input_party:string,role:string,score:double,list_name:string,exact_match:boolean>"
AI = "struct<hs_predictions:array<struct<chapter:string,title:string,similarity:double>>,declared_similarity:double,dual_use:array<struct<concept:string,similarity:double>>,coherence:double>"
