"""Language profiles and rule tables. The lists here are fixed values: results depend on each entry as it stands."""

# fixed values: entity types and their labels
ENTITY_TYPES = {
    "人物": "Person", "组织": "Organization", "公司": "Organization", "机构": "Organization", "地点": "Location", "城市": "Location",
    "国家": "Location", "事件": "Event", "物品": "Item", "产品": "Item", "概念": "Concept", "称号": "Concept", "金钱数额": "Concept",
    "作品": "CreativeWork", "书籍": "CreativeWork", "音乐": "CreativeWork",
}

# fixed values: predicates and their canonical forms
PREDICATES = {
    "出生于": "born_in", "出生地点": "born_in", "出生在": "born_in", "生于": "born_in",
    "任职于": "works_at", "就职于": "works_at", "工作于": "works_at", "在...工作": "works_at", "供职于": "works_at",
    "创办": "founded", "创立": "founded", "创建": "founded", "成立": "founded",
    "爱慕": "loves", "相爱": "loves", "恋人": "loves", "配偶": "spouse_of", "结婚": "spouse_of", "嫁给": "spouse_of", "娶了": "spouse_of",
    "朋友": "friend_of", "好友": "friend_of", "知己": "friend_of", "合作": "collaborates_with", "合伙人": "collaborates_with",
    "冲突": "conflicts_with", "对立": "conflicts_with", "针对": "conflicts_with", "评价": "evaluates", "评论": "evaluates", "评价了": "evaluates",
    "赠送": "gives_to", "送给": "gives_to", "赠予": "gives_to", "借钱": "lends_to", "借款": "lends_to", "委托": "entrusts", "委托给": "entrusts",
    "属于": "belongs_to", "隶属": "belongs_to", "管辖": "governs", "管理": "manages", "领导": "leads", "指导": "mentors", "教导": "mentors",
    "策划": "plans", "设计": "designs", "投资": "invests_in", "收购": "acquires", "拥有": "owns", "持有": "owns",
    "参与": "participates_in", "加入": "joins", "离开": "leaves", "退出": "leaves", "居住": "lives_in", "住在": "lives_in",
    "留学": "studies_in", "学习": "studies_at", "毕业于": "graduated_from", "出版": "publishes", "写作": "writes", "创作": "creates",
    "演奏": "performs", "演唱": "performs",
}

# fixed values: words that speak for a question of several parts
MULTI_PART_ZH = [
    "和", "以及", "还有", "另外", "分别", "各自", "对比", "比较", "区别", "不同", "异同", "为什么", "怎么", "如何", "影响", "导致",
    "先", "后", "然后", "之后", "接着", "第一", "第二", "首先", "其次", "同时", "另一方面", "不仅如此", "原因", "结果", "后果", "后来",
]
MULTI_PART_LATIN = [" and ", " und ", " et ", " para ", " with ", " from ", " dans ", " que "]

# fixed values: names and predicates that extraction drops
PRONOUNS = ["我", "你", "他", "她", "它", "我们", "你们", "他们", "她们", "吾", "汝", "其", "之", "自己", "本人", "敝人", "在下", "俺", "咱", "咱们", "人家", "别人", "自个", "自身"]
GENERIC_NAMES = ["某人", "一个人", "那个女人", "这个男", "那位", "这位", "所有人", "大家", "谁", "什么", "哪", "某个", "那人", "那女人", "这女人", "这男人", "那男人"]
TRIVIAL_PREDICATES = [
    "说了", "看了", "走了", "坐了", "吃了", "喝了", "拿了", "放了", "站了", "笑了", "哭了", "来了", "去了", "进了", "出了",
    "说过", "看过", "走过", "坐过", "吃过", "喝过", "拿过", "说", "看", "走", "坐", "吃", "喝", "拿", "放", "站", "笑", "哭",
    "点头", "摇头", "看了一眼", "听见", "听到", "打电话给", "前往", "交付", "支付", "递交", "交给", "递给", "递交电话给", "打招呼", "通知", "询问", "请求",
    "驾车前往", "驾车", "送", "送别", "握手", "介绍认识", "播放", "接过", "拨通", "接到", "相识于",
]
FEMALE_KEYWORDS = ["女子组", "女刑警", "女警官", "女警"]
POSSESSION = ["获得", "持有", "拥有", "通过", "考取", "荣获", "取得", "拿到", "领到", "获取", "得到", "考过", "获得过"]
MIN_NAME, MIN_PREDICATE, MIN_DESCRIPTION = 2, 2, 5

# fixed values: retrieval and chunking parameters
TOP_K, POOL, FINAL_K, RRF_K = 30, 20, 10, 60.0
REDUNDANT_SHARE, GAP, MIN_CANDIDATES, MAX_CANDIDATES = 0.5, 0.2, 10, 30
VECTOR_MIN, BM25_MIN, BM25_K1, BM25_B = 0.1, 0.3, 1.5, 0.75
CHUNK_SIZE, CHUNK_OVERLAP = 1024, 102
SECTION_ZH = r"[一二三四五六七八九十]{1,3}、|第[一二三四五六七八九十百千]+[回章节篇]"
HEAD_DUN, HEAD_HUI = r"[一二三四五六七八九十]{1,3}、", r"第[一二三四五六七八九十百千]+[回章节篇]"
SUBSECTION_ZH = r"(?m)^(?:　+\d{1,2}|第\d{1,2}节)\s*$"
SECTION_LATIN = r"(?:The|La|Der|El|En|That) "
HAN = r"[一-鿿㐀-䶿豈-﫿]"
