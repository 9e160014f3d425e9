"""Ordered vocabularies and character tables.  The order decides which entry wins."""

from __future__ import annotations

import unicodedata

# Results depend on these entries and on their order.
SKILLS = [
    "JavaScript", "TypeScript", "Python", "Java", "Go", "Golang", "Rust", "C++", "C#", "PHP", "Ruby", "Kotlin", "Swift", "Scala", "Dart", "SQL", "Shell", "Bash",
    "HTML", "CSS", "SCSS", "Less", "Sass", "React", "Vue", "Vue.js", "Vue3", "Angular", "Svelte", "Next.js", "Nuxt", "Webpack", "Vite", "Rollup", "Babel", "ESLint", "Tailwind", "Element UI", "Ant Design", "ECharts", "Three.js", "UniApp", "Taro", "React Native", "Flutter", "Electron", "小程序", "小程序开发",
    "Node.js", "Express", "Koa", "NestJS", "Fastify", "Spring", "Spring Boot", "Django", "Flask", "FastAPI", "Gin", "Echo", "gRPC", "GraphQL", "RESTful", "微服务", "Serverless",
    "MySQL", "PostgreSQL", "MongoDB", "Redis", "Elasticsearch", "ClickHouse", "SQLite", "Oracle", "Kafka", "RabbitMQ", "RocketMQ", "ETL", "数据仓库", "Hive", "Spark", "Flink",
    "Docker", "Kubernetes", "K8s", "Nginx", "Linux", "CI/CD", "Jenkins", "GitLab CI", "GitHub Actions", "AWS", "Azure", "阿里云", "腾讯云", "Prometheus", "Grafana", "ELK", "Terraform", "Ansible",
    "OpenAI API", "LLM", "大模型", "Prompt Engineering", "提示词工程", "RAG", "LangChain", "LlamaIndex", "Agent", "智能体", "MCP", "Fine-tuning", "微调", "PyTorch", "TensorFlow", "Transformers", "Hugging Face", "Pandas", "NumPy", "机器学习", "深度学习", "NLP", "计算机视觉", "向量数据库", "Milvus", "Pinecone", "Faiss",
    "Git", "SVN", "Jest", "Vitest", "Mocha", "Cypress", "Playwright", "Puppeteer", "单元测试", "性能优化", "架构设计", "技术方案设计", "Code Review", "Agile", "Scrum", "Jira", "Kubernetes Operator",
    "项目管理", "团队管理", "需求分析", "跨部门协作", "英语读写", "技术分享",
]

CITIES = [
    "北京", "上海", "深圳", "广州", "杭州", "成都", "南京", "武汉", "西安", "苏州", "天津", "重庆", "长沙", "郑州", "青岛",
    "合肥", "厦门", "福州", "济南", "大连", "宁波", "无锡", "珠海", "东莞", "佛山", "沈阳", "哈尔滨", "昆明", "南昌", "贵阳",
    "南宁", "石家庄", "太原", "兰州", "乌鲁木齐", "海口", "三亚", "长春", "银川", "西宁", "呼和浩特", "拉萨", "香港", "澳门", "台北",
]

DEGREES = {"博士后": 5, "博士": 5, "硕士": 4, "研究生": 4, "MBA": 4, "本科": 3, "学士": 3, "大专": 2, "专科": 2, "高中": 1, "中专": 1}

RADICALS = {
    "\u2E81": "厂", "\u2E84": "乙", "\u2E87": "几", "\u2E8A": "卜", "\u2E8B": "卩", "\u2E90": "尢", "\u2E91": "尢", "\u2E93": "幺", "\u2E98": "手", "\u2E99": "攴",
    "\u2E9C": "日", "\u2E9D": "月", "\u2E9E": "歹", "\u2EA3": "火", "\u2EA4": "爪", "\u2EA5": "爪", "\u2EA6": "爿", "\u2EA7": "牛", "\u2EA8": "犬", "\u2EA9": "玉",
    "\u2EAA": "疋", "\u2EAB": "目", "\u2EAE": "竹", "\u2EAF": "糸", "\u2EB0": "纟", "\u2EB3": "网", "\u2EB4": "网", "\u2EB6": "羊", "\u2EB9": "老", "\u2EBC": "肉",
    "\u2EBD": "臼", "\u2EC0": "艹", "\u2EC1": "虍", "\u2EC2": "衣", "\u2EC5": "见", "\u2EC6": "角", "\u2EC7": "角", "\u2EC8": "讠", "\u2EC9": "贝", "\u2ECA": "足",
    "\u2ECB": "车", "\u2ECC": "辶", "\u2ECF": "邑", "\u2ED3": "长", "\u2ED4": "门", "\u2ED7": "雨", "\u2ED8": "青", "\u2EDA": "页", "\u2EDB": "风", "\u2EDC": "飞",
    "\u2EDF": "食", "\u2EE0": "饣", "\u2EE1": "首", "\u2EE2": "马", "\u2EE3": "骨", "\u2EE4": "鬼", "\u2EE5": "鱼", "\u2EE6": "鸟", "\u2EE7": "卤", "\u2EE8": "麦",
    "\u2EE9": "黄", "\u2EEA": "黾", "\u2EEB": "齐", "\u2EEC": "齐", "\u2EED": "齿", "\u2EEE": "齿", "\u2EF1": "龟", "\u2EF2": "龟", "\u2EF3": "龟",
}

KEPT_FULLWIDTH = "！（），：；？"
# End of the fixed values.

ASCII_SKILLS = [s for s in SKILLS if s.isascii()]


def compat_table() -> tuple[str, str]:
    """(characters, replacements) of equal length: explicit radicals first, then what NFKC gives
    for Kangxi radicals, compatibility ideographs and half-width kana, then full-width ASCII."""
    table = dict(RADICALS)
    for lo, hi in ((0x2F00, 0x2FDF), (0xF900, 0xFAFF), (0xFF66, 0xFFDC)):
        for cp in range(lo, hi + 1):
            to = unicodedata.normalize("NFKC", chr(cp))
            if to != chr(cp):
                assert len(to) == 1
                table.setdefault(chr(cp), to)
    for cp in range(0xFF01, 0xFF5F):
        if chr(cp) not in KEPT_FULLWIDTH:
            table[chr(cp)] = chr(cp - 0xFEE0)
    return "".join(table), "".join(table.values())
