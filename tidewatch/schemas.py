"""Table layouts, as DDL strings."""

RAW_ITEM = ("seq BIGINT, title STRING, link STRING, pub_date STRING, summary_raw STRING, source_type STRING, "
            "source_name STRING, fetched_at TIMESTAMP_NTZ")

ARTICLE_TEXT_COLUMNS = ["title", "title_cn", "pub_date", "source_type", "source_name", "summary_cn",
                        "full_text_cn", "content", "screenshot_path", "vl_desc", "remark"]
ARTICLE_FLAG_COLUMNS = ["is_significant", "valid", "is_hidden", "is_retained"]

TRACK = ("id BIGINT, mmsi STRING, vessel_name STRING, lat DOUBLE, lng DOUBLE, speed DOUBLE, heading DOUBLE, "
         "status_raw STRING, timestamp TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ")

SHIP_COLUMNS = ["id", "imo", "mmsi", "name", "company", "type", "capacity_1", "capacity_2", "region", "location",
                "status", "status_date", "remarks", "updated_at", "country", "continent", "province", "city",
                "speed", "heading"]
# not overwritten when a known ship is imported again
SHIP_KEPT_ON_UPDATE = ["speed", "heading"]

SOURCE = ("name STRING, url STRING, type STRING, selector STRING, max_links INT, blacklist ARRAY<STRING>, "
          "fakeid STRING")

FLEET_PAYLOAD = ("result STRING, list ARRAY<STRUCT<mmsi: STRING, lat: DOUBLE, lon: DOUBLE, speed: DOUBLE, "
                 "heading: DOUBLE, status: STRING, updatetime: STRING, shipname: STRING, name: STRING>>")

WECHAT_PAGE = ("base_resp STRUCT<ret: INT>, app_msg_list ARRAY<STRUCT<title: STRING, link: STRING, "
               "update_time: BIGINT, digest: STRING, cover: STRING>>")

RSS_DOC = ("channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: STRING, pubDate: STRING, updated: STRING, "
           "description: STRING>>>")

MODEL_RESULT = ("is_junk BOOLEAN, category STRING, title_cn STRING, summary_cn STRING, full_text_cn STRING, "
                "publish_time STRING, image_desc STRING")

EVENTS_FILE = ("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING")
DOCUMENTS_FILE = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
