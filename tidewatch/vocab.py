"""Category names, keyword lists, labels and limits.

Everything in this module is a fixed value the results depend on, stated as plain data.
"""

# --- categories (fixed values) ---
CATEGORIES = ["Bid", "Equipment", "Market", "Project", "Regulation", "R&D", "Other"]
DEFAULT_CATEGORY = "Market"

# ordered: the first bucket with a hit wins
CATEGORY_KEYWORDS = [
    ("Bid", ["contract", "tender", "bid", "award", "funding", "budget", "procurement"]),
    ("Equipment", ["delivery", "launch", "vessel", "ship", "dredger", "keel", "shipyard", "equipment", "fleet"]),
    ("Market", ["acquire", "acquisition", "merger", "financial", "profit", "revenue", "earnings", "market",
                "investor", "share", "plan", "planning", "strategy", "strategic", "roadmap", "program",
                "programme", "initiative", "five-year", "five year", "5-year", "master plan", "protest",
                "strike", "blockade", "demonstration", "dispute", "conflict"]),
    ("Project", ["project", "construction", "progress", "dredging", "completion", "completed", "underway",
                 "restoration", "maintenance", "works"]),
    ("Regulation", ["regulation", "policy", "law", "act", "legislation", "tariff", "compliance", "standard",
                    "guideline", "guidelines", "requirement", "requirements", "permit", "approval", "overview",
                    "introduction", "intro", "basics", "guide", "101"]),
    ("R&D", ["research", "technology", "innovation", "laboratory", "prototype", "r&d", "rd"]),
]
CATEGORY_ALIASES = {
    "bid": "Bid", "equipment": "Equipment", "market": "Market", "news": "Market", "新闻": "Market",
    "project": "Project", "regulation": "Regulation", "r&d": "R&D", "rd": "R&D", "r and d": "R&D",
    "research and development": "R&D",
}
# aliases compared after dropping everything but letters and digits
CATEGORY_COMPACT_ALIASES = {"rd": "R&D", "researchdevelopment": "R&D"}
PRIMARY_CATEGORY_ORDER = ["Bid", "Project", "Equipment", "Regulation", "R&D", "Market"]

# chart labels of the statistics report (no entry for Other)
CATEGORY_CHART_LABELS = {
    "Bid": "中标信息", "Equipment": "装备动态", "Market": "市场情报", "Project": "项目进展",
    "Regulation": "政策法规", "R&D": "科技研发", "Unknown": "未知", "None": "未知",
}
# display labels of the article lists
CATEGORY_DISPLAY_LABELS = {
    "Market": "市场动态", "Bid": "中标信息", "Project": "项目信息", "Equipment": "设备修造",
    "R&D": "科技研发", "Regulation": "技术法规", "Other": "其他信息",
}
# short labels of the digest line, in line order
DIGEST_LABELS = [("Market", "市场"), ("Bid", "中标"), ("Project", "项目"), ("Equipment", "设备"),
                 ("R&D", "研发"), ("Regulation", "法规")]
# section titles of the written report, in section order
REPORT_SECTIONS = [
    ("Market", "📈 市场动态 (Market Dynamics)"), ("Bid", "💰 中标信息 (Bid Information)"),
    ("Project", "🏗️ 项目信息 (Project Status)"), ("Equipment", "🛠️ 设备修造 (Equipment & Shipbuilding)"),
    ("R&D", "🔬 科技研发 (R&D)"), ("Regulation", "⚖️ 技术法规 (Regulation)"),
]

# --- relevance (fixed values) ---
RELEVANT_SOURCE_WORDS = ["疏浚", "航道", "港航", "港口", "港务", "航务", "水道", "水运", "海工", "中交",
                         "dredg", "dredging", "waterway", "harbor", "harbour", "port"]
RELEVANT_URL_WORDS = ["dredg", "dredging", "waterway", "harbor", "harbour", "port", "channel"]
STRONG_WORDS = ["dredg", "dredger", "dredging", "dredged", "疏浚", "清淤", "吹填", "挖泥", "补砂", "海滩补砂",
                "航道疏浚", "港池疏浚"]
SECONDARY_WORDS = ["port", "harbor", "harbour", "channel", "waterway", "navigation", "sediment", "reclamation",
                   "coastal", "estuary", "river", "terminal", "berth", "quay", "dock", "maritime", "seabed",
                   "offshore", "航道", "港口", "港航", "码头", "航运", "河道", "运河", "海岸", "海工", "海洋工程",
                   "船坞", "泊位", "航道维护", "疏港", "港池", "填海", "围填海", "河口"]

# --- junk and boilerplate (fixed values) ---
JUNK_TITLES = ["重回主页", "董事会", "监事会", "股东大会", "首页", "主页", "Home", "Back to Home", "Login", "Sign in",
               "Register", "About Us", "Contact Us", "Site Map", "Privacy Policy", "Terms of Use", "Search", "Menu",
               "Navigation", "English", "Español", "Français", "Deutsch", "中文", "Skip to main content",
               "ENTER YOUR ADMIN USERNAME"]
ERROR_TITLE_PARTS = ["404 Not Found", "Page Not Found", "Access Denied", "Browser Update", "Enable JavaScript"]
JUNK_TITLE_PARTS = ["skip to", "back to", "return to", "go to", "home", "homepage", "frontpage", "main menu",
                    "previous", "next", "read more", "learn more", "cookie", "accept", "agree", "privacy policy",
                    "terms of", "contact us", "about us", "sitemap", "accessibility", "subscribe",
                    "board of directors", "management team", "executive team", "investor relations",
                    "financial reports", "career", "job", "vacancy", "vacancies", "mailchimp", "email service",
                    "correcting the record", "unsubscribe", "view in browser", "update your preferences"]
SECURITY_TITLE_PARTS = ["your connection is not private", "privacy error", "connection is not secure",
                        "您的连接不是私密连接", "您的连接不是安全连接", "此连接不是私密连接"]
BOILERPLATE_WORDS = ["skip to main content", "about", "what we do", "home", "menu", "search", "privacy policy",
                     "terms of use", "cookie", "contact", "subscribe", "sign in", "register", "login", "language"]
NAV_TITLE_PARTS = ["skip to", "back to", "home", "menu", "cookie", "privacy"]
SITE_EXCLUDED_PARTS = ["unsubscribe", "subscription", "media-library", "cookie", "privacy", "terms", "contact",
                       "about", "career", "investor"]
SITE_EXCLUDED_HREF_PARTS = ["unsubscribe", "subscription", "media-library", "#"]
TITLE_STOPWORDS = ["集团", "公司", "股份", "有限", "有限公司", "达成", "签订", "签署", "修改", "修订", "协议",
                   "合作", "宣布", "公告"]

# --- urls (fixed values) ---
TRACKING_PARAMS = ["gclid", "fbclid", "igshid", "mc_cid", "mc_eid", "mkt_tok", "spm", "ref", "referrer", "from",
                   "share"]

# --- page extraction (fixed values) ---
CONTENT_SELECTORS = ["article", ".post-content", ".entry-content", ".article-content", ".article-body",
                     "#article-body", ".body-content", ".main-content", "main", "#content", ".content"]
SITE_LINK_SELECTORS = ["article", ".news-item", ".card", ".news", ".press-item", ".release", ".item",
                       '[class*="news"]', '[class*="press"]', "h2", "h3", "h4", ".overview", ".listing", ".items"]

# --- remarks written into results (fixed values) ---
R_EMPTY = "标题或链接为空"
R_DUPLICATE = "重复链接(任务内)"
R_PROCESSED = "已存在且已处理"
R_FILTERED = "采集阶段过滤: "
R_NO_DATE = "发布时间缺失"
R_OLD = "发布时间早于5天(已入库)"
R_OLD_RUN = "发布时间早于5天"
R_PENDING = "待分析"
R_STALE = "过期"
R_KEPT = "保留"
R_IRRELEVANT = "AI判定无关"
R_INVALID = "无效数据"
R_JUNK_TITLE = "标题命中垃圾关键词"
R_JUNK_RESULT = "判定为垃圾信息"
R_FAILED_RESULT = "分析失败"
R_JUNK_SUMMARY = "垃圾信息/非新闻页面"
R_NO_SUMMARY = "暂无摘要"
R_ENRICH_NO_DATE = " (补充采集仍无时间)"
R_ENRICH_OLD = "补充采集后判定过期"
DATELESS_SOURCES = ["web", "official", "rsshub"]

# --- labels (fixed values) ---
SOURCE_LABELS = {"rss": "RSS", "web": "Web", "wechat": "公众号", "rsshub": "公众号", "official": "公众号"}
STATUS_LABELS = {"dredging": "作业中", "underway": "航行中", "moored": "停泊", "untracked": "未跟踪"}
STATUS_LABEL_DEFAULT = "离线"
FLEET_ORDER = ["上航局", "天航局", "广航局", "Boskalis", "DEME", "JanDeNUL", "NMDC", "VanOORD"]
FLEET_OTHER = "其他"
# company text parts -> fleet, first hit wins
FLEET_RULES = [
    (["上航", "shanghai"], "上航局"), (["天航", "tianjin"], "天航局"), (["广航", "guangzhou"], "广航局"),
    (["boskalis"], "Boskalis"), (["deme"], "DEME"), (["jan de nul", "jandenul"], "JanDeNUL"),
    (["nmdc"], "NMDC"), (["van oord", "vanoord"], "VanOORD"),
]
STATUS_EXACT = {
    "dredging": "dredging", "underway using engine": "underway", "underway": "underway", "moored": "moored",
    "at anchor": "moored", "stopped": "moored", "offline": "offline", "unknown": "offline",
}
# ordered substrings, first hit wins
STATUS_PARTS = [
    (["施工", "作业", "疏浚", "dredging", "操纵能力受限", "restricted maneuverability"], "dredging"),
    (["机动船在航", "underway", "moving", "调遣"], "underway"),
    (["锚泊", "系泊", "停泊", "停靠", "抛锚", "moored", "anchor"], "moored"),
]
CONTINENT_CODES = {"NA": "North America", "SA": "South America", "AS": "Asia", "OC": "Oceania", "AF": "Africa",
                   "EU": "Europe", "AN": "Antarctica"}
CONTINENT_LABELS = {"Asia": "亚洲", "Europe": "欧洲", "Africa": "非洲", "North America": "北美洲",
                    "South America": "南美洲", "Oceania": "大洋洲", "Antarctica": "南极洲", "Unknown": ""}
COUNTRY_LABELS = {
    "China": "中国", "CN": "中国", "United States": "美国", "US": "美国", "USA": "美国", "Netherlands": "荷兰",
    "NL": "荷兰", "Singapore": "新加坡", "SG": "新加坡", "Malaysia": "马来西亚", "MY": "马来西亚", "Japan": "日本",
    "JP": "日本", "Korea": "韩国", "KR": "韩国", "South Korea": "韩国", "Australia": "澳大利亚", "AU": "澳大利亚",
    "United Kingdom": "英国", "UK": "英国", "GB": "英国", "Germany": "德国", "DE": "德国", "France": "法国",
    "FR": "法国", "Indonesia": "印度尼西亚", "ID": "印度尼西亚", "India": "印度", "IN": "印度", "Russia": "俄罗斯",
    "RU": "俄罗斯", "Saudi Arabia": "沙特阿拉伯", "SA": "沙特阿拉伯", "United Arab Emirates": "阿联酋",
    "AE": "阿联酋", "Brazil": "巴西", "BR": "巴西", "Vietnam": "越南", "VN": "越南", "Philippines": "菲律宾",
    "PH": "菲律宾",
}

# --- units and limits (fixed values) ---
KNOT_MS = 0.514444
EARTH_RADIUS_M = 6371000.0
MAX_SEGMENT_MS = 15.0
DRIFT_M = 80.0
SPEED_TAIL = 24
TRACK_KEEP = 5000
FRESH_DAYS = 5
STALE_DAYS = 30

# audit remarks after the analysis (fixed values)
A_UNRELATED = "AI判定无关: 非疏浚主题"
A_INVALID = "无效数据 (valid=0)"
A_NOT_KEPT = "未保留 (is_retained=0)"
A_NO_RESULT = "分析未通过(可能提取失败)"

# headings and marks of digests, reports and audit files (fixed values; stored files are read back by them)
MORNING, EVENING = "早报", "晚报"
DIGEST_NAME = "情报简报"
DIGEST_NONE = "截至目前，暂无最新情报更新。"
NO_PICTURE = "无视觉分析"
PICTURE_NOTE = "视觉补充"
AUDIT_HEADER = ["| 序号 | 网站 | 新闻名称 | 发布时间 | 是否保留 | TextLLM识别成功 | VL识别成功 | 数据来源 | 备注 | 新闻链接 |",
                "| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |"]
