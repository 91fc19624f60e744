"""Word lists, maps and thresholds whose content decides results.

Every operator takes its lexicon as a parameter; these are the Chinese defaults.
"""

# --- fixed values: digits ---------------------------------------------------
CHINESE_DIGITS = "零〇○一二三四五六七八九"
ARABIC_DIGITS = "000123456789"
CHINESE_MONTHS = {
    "一": "1", "二": "2", "三": "3", "四": "4", "五": "5", "六": "6",
    "七": "7", "八": "8", "九": "9", "十": "10", "十一": "11", "十二": "12",
}

# --- fixed values: places ---------------------------------------------------
CITIES = [
    "北京", "上海", "广州", "深圳", "杭州", "南京", "武汉", "成都", "重庆",
    "天津", "苏州", "西安", "郑州", "长沙", "青岛", "沈阳", "大连",
    "佛山", "东莞", "宁波", "无锡", "合肥", "昆明", "厦门", "济南",
]
HOME_WORDS = ["老家", "家乡", "故乡", "屋里", "房子", "房间"]
SEGMENT_PLACES = [
    "北京", "上海", "广州", "深圳", "天津", "重庆", "南京", "武汉", "成都",
    "杭州", "西安", "长沙", "沈阳", "哈尔滨", "大连", "青岛", "厦门", "苏州",
    "东北", "华北", "华南", "西南", "西北", "华东", "陕北", "延安", "香港",
    "台湾", "新疆", "西藏", "内蒙古", "广东", "浙江", "江苏", "福建", "四川",
]
NEARBY_CITIES = ["深圳", "东莞", "佛山", "珠海", "中山"]
REGIONS = ["广东", "珠三角", "珠江三角洲", "粤港澳"]
ENTITY_PLACE_ALIASES = {
    "深圳": "SHENZHEN", "北京": "BEIJING", "上海": "SHANGHAI",
    "广州": "GUANGZHOU", "香港": "HONG KONG",
    "广东": "GUANGDONG", "佛山": "FOSHAN", "东莞": "DONGGUAN",
}
REGION_PLACE_ALIASES = {
    "广州": "GUANGZHOU", "广东": "GUANGDONG",
    "佛山": "FOSHAN", "东莞": "DONGGUAN", "深圳": "SHENZHEN",
}
TERM_ALIASES = {
    "深圳": "SHENZHEN", "上海": "SHANGHAI", "北京": "BEIJING", "广州": "GUANGZHOU",
    "香港": "HONG KONG", "中国": "CHINA", "邓小平": "DENG XIAOPING", "蛇口": "SHEKOU",
    "经济特区": "SPECIAL ECONOMIC ZONE", "改革开放": "REFORM AND OPENING",
}
NAME_VARIANTS = {
    "深圳": ["SHENZHEN", "深圳", "shenzhen"],
    "邓小平": ["DENG XIAOPING", "邓小平", "deng xiaoping"],
    "上海": ["SHANGHAI", "上海", "shanghai"],
    "北京": ["BEIJING", "北京", "beijing"],
    "香港": ["HONG KONG", "香港", "hong kong"],
    "浦东新区": ["PUDONG", "浦东", "pudong"],
    "经济特区": ["SPECIAL ECONOMIC ZONE", "经济特区", "SEZ"],
    "改革开放": ["REFORM AND OPENING", "改革开放", "reform"],
    "奥运会": ["OLYMPICS", "奥运会", "olympic"],
    "世博会": ["WORLD EXPO", "世博会", "expo"],
    "WTO": ["WTO", "世界贸易组织", "WORLD TRADE ORGANIZATION"],
    "南巡": ["SOUTHERN TOUR", "南巡", "southern tour"],
    "回归": ["RETURN", "回归", "handover"],
}
PLACE_SPELLINGS = {
    "北京": ["beijing", "北京市", "peking"],
    "上海": ["shanghai", "上海市"],
    "深圳": ["shenzhen", "深圳市"],
    "广州": ["guangzhou", "广州市", "canton"],
    "中国": ["china", "prc", "people's republic of china"],
    "美国": ["usa", "us", "united states", "america"],
    "英国": ["uk", "britain", "united kingdom"],
    "日本": ["japan"],
    "香港": ["hong kong", "hongkong", "hk"],
    "台湾": ["taiwan"], "澳门": ["macao", "macau"], "天津": ["tianjin"],
    "重庆": ["chongqing"], "南京": ["nanjing", "nanking"], "武汉": ["wuhan"],
    "成都": ["chengdu"], "西安": ["xian", "xi'an"], "杭州": ["hangzhou"],
    "苏州": ["suzhou"], "青岛": ["qingdao"], "大连": ["dalian"], "沈阳": ["shenyang"],
    "哈尔滨": ["harbin"], "长春": ["changchun"], "济南": ["jinan"], "郑州": ["zhengzhou"],
    "长沙": ["changsha"], "福州": ["fuzhou"], "厦门": ["xiamen"], "南昌": ["nanchang"],
    "合肥": ["hefei"], "太原": ["taiyuan"], "石家庄": ["shijiazhuang"],
    "呼和浩特": ["hohhot"], "乌鲁木齐": ["urumqi"], "拉萨": ["lhasa"],
    "兰州": ["lanzhou"], "西宁": ["xining"], "银川": ["yinchuan"], "南宁": ["nanning"],
    "昆明": ["kunming"], "贵阳": ["guiyang"], "海口": ["haikou"],
}

# --- fixed values: retrieval filters ----------------------------------------
STOP_ENTITIES = [
    "中国", "中华人民共和国", "北京", "国务院", "STATE COUNCIL",
    "中共中央", "CPC CENTRAL COMMITTEE", "中央政府", "中央",
    "EUROPEAN UNION", "欧盟", "BRICS",
    "SHANGHAI", "BEIJING", "上海", "天津", "TIANJIN", "重庆", "CHONGQING",
    "成都", "CHENGDU", "武汉", "WUHAN", "杭州", "HANGZHOU",
]
RELATION_BLOCKLIST = [
    "嫦娥", "CHANG", "探月", "月球", "BRICS", "金砖",
    "维和", "平潭", "滨海新区", "塘沽", "汉沽", "大港",
    "里斯本", "欧盟", "EKATERINBURG", "嫦娥一号",
    "BINHAI", "DAGANG", "TANGGU", "HANGU", "LISBON",
    "上海", "SHANGHAI", "北京", "BEIJING", "天津", "TIANJIN",
    "成都", "CHENGDU", "武汉", "WUHAN", "杭州", "HANGZHOU",
    "莫斯科", "MOSCOW", "叶卡捷琳堡",
]
TEXT_BLOCKLIST = [
    "嫦娥", "探月", "月球", "BRICS", "金砖", "维和", "平潭", "滨海新区",
    "里斯本", "欧盟", "HU JINTAO", "JIANG ZEMIN", "DENG XIAOPING",
]
PERSON_TYPES = ["PERSON", "人物"]
ORGANISATION_TYPES = ["ORGANIZATION", "组织"]

# --- fixed values: keyword lists --------------------------------------------
EVENT_TERMS = [
    "外贸", "出口", "金融危机", "亚运会", "亚运", "广交会", "交易会",
    "经济", "创业", "改革", "开放", "建设", "发展", "投资", "产业",
    "制造业", "电子", "纺织", "服装", "科技", "互联网", "电商",
    "创业板", "股票", "金融", "房地产", "楼市", "政策", "政策变化",
    "地铁", "交通", "基建", "城市建设", "环境", "环保", "污染",
]
KEYWORD_STOP_WORDS = [
    "广州", "深圳", "上海", "北京", "湖南", "四川", "湖北", "河南", "河北",
    "中国", "广东", "广西", "福建", "江西", "安徽", "江苏", "浙江",
    "天河", "白云", "越秀", "海珠", "番禺", "珠海", "东莞", "佛山",
    "香港", "澳门", "台湾", "老家", "家乡", "故乡",
    "到处", "处都", "那个", "什么", "怎么", "为什么", "哪里",
    "时候", "那年", "每天", "早上", "晚上", "周末", "年底",
    "春天", "夏天", "秋天", "冬天",
    "云吞面", "肠粉", "美食", "骑楼", "步行街", "图书馆",
    "老板", "同事", "员工", "公司", "客户", "外商",
    "我们", "他们", "你们", "我", "他", "她", "它", "这", "那", "此",
    "但", "但是", "却", "而", "和", "与", "及", "以及",
    "的", "了", "是", "在", "有", "不", "人", "都", "一", "上", "也",
    "很", "到", "说", "要", "去", "会", "着", "没有", "看", "好",
    "自己", "知道", "下", "还", "就", "把", "给", "做", "让", "能",
    "可以", "应该", "觉得", "时间", "事情", "东西", "问题", "方面",
    "800", "100", "10", "5", "20", "30", "1", "2", "3", "4",
    "但离", "不远", "心里", "充满", "干劲", "努力", "介绍", "产品",
    "意向", "表扬", "高兴", "温暖", "活力", "未来", "开始", "过来",
]
PHRASE_STOP_WORDS = [
    "我们", "他们", "她们", "自己", "大家", "这些", "那些", "这个", "那个",
    "它们", "别人", "人们", "有人", "谁都", "每个", "各种",
    "可以", "已经", "还是", "就是", "因为", "所以", "但是", "如果", "虽然",
    "而且", "或者", "以及", "对于", "关于", "通过", "进行", "没有", "不了",
    "不过", "于是", "终于", "然后", "并且", "不仅", "只要", "无论",
    "起来", "出来", "下来", "过来", "上去", "出去", "下去", "回来",
    "时候", "当时", "那时", "这时", "之后", "以后", "以前", "之前",
    "那年", "那天", "后来", "其实", "还有", "只有", "就像",
    "一个", "一些", "一种", "一次", "一点", "一样", "什么", "怎么",
    "这样", "那样", "非常", "十分", "特别", "比较",
    "觉得", "知道", "开始", "成为", "看到", "听到", "感到", "想到",
    "说道", "能够", "应该", "需要", "希望", "喜欢", "认为", "发现",
    "不知道", "那时候", "的时候",
]
FACT_STOP_WORDS = [
    "一个", "一些", "这个", "那个", "我们", "他们", "自己", "什么",
    "可以", "已经", "开始", "成为", "不是", "没有", "但是", "因为",
    "所以", "如果", "就是", "虽然", "仿佛", "似乎", "好像", "如同",
    "依旧", "依然", "终于", "渐渐", "慢慢", "忽然", "不断", "只是",
    "然而", "同时", "随着", "每个", "无数", "整个",
]
FACT_MARKERS = [
    "会议", "全会", "大会", "代表", "政策", "制度", "法律", "条例",
    "特区", "开发区", "示范区", "公司", "企业", "集团", "组织",
]
RELATION_STOP_WORDS = ["了", "的", "是", "在", "有", "和"]
CATEGORY_RULES = [
    ("经济/外贸", ["外贸", "经济", "GDP", "金融", "出口", "贸易"]),
    ("交通/基建", ["地铁", "交通", "高铁", "机场", "道路"]),
    ("文化/教育", ["文化", "教育", "图书馆", "博物馆", "艺术"]),
    ("社会/民生", ["社保", "医疗", "民生", "就业", "扶贫"]),
    ("科技/产业", ["科技", "创新", "产业", "高交会", "研发"]),
]
CATEGORY_DEFAULT = "其他"

# --- fixed values: style word lists -----------------------------------------
TRANSITION_WORDS = [
    "那时", "当时", "正是", "与此同时", "记得", "那个年代",
    "在那个时候", "彼时", "此时", "随后", "紧接着", "于是",
    "就这样", "从此", "后来", "那一年", "那年",
]
SIMPLE_TRANSITION_WORDS = ["那时", "当时", "正是", "与此同时", "记得", "那个年代"]
RICHNESS_PATTERNS = [
    "[形色声味触]", "[一-龥]{2,4}的", "如同|仿佛|好像|宛如", "[喜怒哀乐悲欢离合]",
]

# --- fixed values: detector patterns ----------------------------------------
SUMMARY_METRIC_PATTERN = (
    "总之|综上|总而言之|总的来说|总体而言|概括地说|简而言之|"
    "由此可见|可以看出|不难看出|归根结底|一言以蔽之"
)
SUMMARY_GATE_PATTERN = (
    "总之|综上|总而言之|总的来说|总体而言|回顾|纵观|概括地说|简而言之|"
    "由此可见|可以看出|不难看出|归根结底|一言以蔽之"
)
BOILERPLATE_PATTERN = (
    "在这个大背景下|在这样的时代背景下|在这种情况下|在这一时期|"
    "正是在这样的|值得一提的是|不可否认的是|众所周知"
)
EPILOGUE_PATTERN = (
    "(?:这(?:段|些)(?:日子|岁月|经历|时光).*?(?:教会|让我|使我|改变|影响|塑造|成就|成长|明白|懂得|铭记|难忘)|"
    "(?:那|这)是.*?(?:最(?:美好|难忘|珍贵|宝贵|深刻|温暖)的|一生中)|"
    "(?:见证|承载|记录)了.*?(?:成长|变迁|变化|岁月|青春|我的)|"
    "(?:在我|在那|从此).*?(?:心中|心底|记忆里|脑海中).*?(?:留下|刻下|种下|埋下|烙下|扎根)|"
    "(?:多年以后|许多年后|后来我才).*?(?:才(?:明白|懂得|知道|理解)|回想|回忆|想起)|"
    "(?:也许|或许).*?正是.*?(?:成就|塑造|造就|奠定)|"
    "(?:这一切|所有这些).*?(?:构成|汇成|编织成|成为).*?(?:底色|篇章|画卷|一部分))"
)
VERIFIABLE_PATTERN = (
    "[0-9一二三四五六七八九十百千万亿]|[年月日号]|省|市|县|区|镇|村|塬|河|山|"
    "会议|全会|政策|制度|法律|条例|特区|开发区|"
    "大学|学院|研究所|公司|企业|组织|团体|主席|总理|部长|书记|院士|教授|队长|"
    "叫|姓|名|是|在|从|到|去|来|做|当|任"
)
PURE_NARRATIVE_PATTERN = (
    "^[^。！？]*(?:阳光|微风|树叶|灯光|气息|味道|声音|窗帘|缝隙|光影|斑驳)[^。！？]*[。！？]?$|"
    "^[^。！？]*(?:激动|兴奋|幸福|期待|憧憬|沉甸甸)[^。！？]*[。！？]?$|"
    "^[^。！？]*(?:坐在|站在|躺在|走进|打开|放下|抬头|低头|闭上)[^。！？]*[。！？]?$"
)
ID_NUMBER_PATTERN = "[0-9]{17}[0-9Xx]"
PHONE_PATTERN = "1[3-9][0-9]{9}"
EMAIL_PATTERN = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"

# --- fixed values: entity rules ---------------------------------------------
SURNAMES = (
    "张王李赵刘陈杨黄周吴徐孙马朱胡郭何高林罗郑梁宋谢唐韩曹许邓萧冯曾程蔡彭潘袁于董余苏叶吕魏蒋田杜丁沈姜范江傅钟"
    "卢汪戴崔任陆廖姚方金邱夏谭韦贾邹石熊孟秦阎薛侯雷白龙段郝孔邵史毛常万顾赖武康贺严尹钱施牛洪龚"
)
NAME_TITLES = "队长|先生|老板|师傅|医生|校长"
GIVEN_NAMES = ["德明", "小军", "父亲", "母亲", "老婆", "女朋友"]
FIGURES = ["邓小平", "毛泽东", "周恩来"]
RULE_PLACES = [
    "北京", "上海", "深圳", "广州", "陕北", "延安", "张家塬", "华强北",
    "武汉", "香港", "兰州", "东南亚", "深圳湾", "窑洞", "公社", "生产队",
    "省城", "县城", "渭河", "黄土高坡",
]
RULE_ORGANISATIONS = ["联想", "海尔", "知青", "研究所"]
FIGURE_TITLE_PATTERN = (
    "老[A-Za-z一-龥]|[A-Za-z一-龥]老师|[A-Za-z一-龥]{2,3}(?:同志|队长|书记|厂长|经理|校长|主任)"
)

# --- fixed values: date and heading patterns --------------------------------
YEAR_PATTERN = "(?:一九[〇零○一二三四五六七八九]{2}|二[〇零○][〇零○一二三四五六七八九]{2}|(?:19|20)[0-9]{2})"
LEADING_YEAR_PATTERN = "^\\s*" + YEAR_PATTERN + "\\s*年"
HEADING_PATTERN = (
    "^\\s*(第[一二三四五六七八九十百千万零〇○0-9]+[章节回部编篇集]|[一二三四五六七八九十]+、|"
    "[（(]?[一二三四五六七八九十]+[）)]、?)\\s*"
)

# --- fixed values: record fields, budgets, weights --------------------------
RECORD_FIELDS = {
    "title": "标题", "date": "日期", "location": "地点", "keywords": "关键词",
    "content": "正文", "summary": "摘要", "description": "描述",
    "source": "来源", "url": "URL",
}
FLAT_TEXT_FIELDS = ["description", "content", "text", "event", "title", "summary"]
EVENT_DEFAULTS = {"title": "未命名事件", "date": "未知时间", "location": "未知地点", "content": ""}
EVENT_LABELS = {"title": "事件标题：", "date": "时间：", "location": "地点："}
BUCKET_TOTALS = {"200-400": 300, "400-800": 600, "800-1200": 1000, "1200+": 2000}
BUCKET_EXPANSION = {"200-400": 0.8, "400-800": 1.2, "800-1200": 1.6, "1200+": 2.0}
BUCKET_HINTS = {
    "200-400": ("200-400字", 800), "400-800": ("400-800字", 1400),
    "800-1200": ("800-1200字", 2200), "1200+": ("1200字以上", 3200),
}
DEFAULT_BUCKET = "400-800"
METRIC_WEIGHTS = {
    "temporal_coherence": 1.0, "topic_coherence": 1.5, "length_score": 0.8,
    "transition_usage": 0.8, "descriptive_richness": 0.8,
    "rag_utilization": 2.0, "hallucination": 2.0,
}
GATE_THRESHOLDS = {
    "min_segment_score": 5.0, "max_cross_repetition": 0.20, "min_fact_score": 0.60,
    "min_length_ratio": 0.40, "max_length_ratio": 2.5, "max_summary_sentence_ratio": 0.30,
    "min_rag_utilization": 0.5, "min_hallucination_score": 0.4, "min_temporal_coherence": 1.0,
}
CASE_FACTS = {
    "SHENZHEN": ("深圳", "1988"), "DENG XIAOPING": ("邓小平", "1992"),
    "BEIJING": ("北京", "2008"), "SHANGHAI": ("上海", "2010"), "HUAWEI": ("华为", "1987"),
}
