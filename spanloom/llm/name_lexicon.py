"""What is known about names of people: short forms of given names, common name parts of scripts without
capital letters, titles. All are fixed values."""

NICKNAMES = {
    "abby": "abigail", "alex": "alexander", "andy": "andrew", "archie": "archibald", "bart": "bartholomew", "becky": "rebecca", "bella": "isabella",
    "ben": "benjamin", "benny": "benjamin", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert",
    "bobby": "robert", "charlie": "charles", "chris": "christopher", "chuck": "charles", "cathy": "katherine", "dan": "daniel", "danny": "daniel",
    "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "ed": "edward", "eddie": "edward", "ella": "eleanor", "ellie": "eleanor",
    "frank": "francis", "fred": "frederick", "freddy": "frederick", "fritz": "frederick", "gabe": "gabriel", "gen": "genevieve", "ginny": "virginia", "gus": "augustus",
    "hal": "harold", "hannes": "johannes", "hank": "henry", "harry": "harold", "isa": "isabella", "izzy": "isabella", "jack": "john",
    "jackie": "jacqueline", "jim": "james", "jimmy": "james", "jo": "josephine joanna", "josie": "josephine", "joe": "joseph", "johnny": "john", "kat": "katherine", "kate": "katherine",
    "kathy": "katherine", "katie": "katherine", "kit": "christopher", "larry": "lawrence", "lena": "milena jelena helena", "leo": "leopold", "lisa": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "lola": "dolores",
    "lupe": "guadalupe", "maggie": "margaret", "matt": "matthias", "max": "maximilian", "meg": "margaret", "mick": "michael", "mike": "michael", "mina": "wilhelmina",
    "minnie": "wilhelmina", "nacho": "ignacio", "ned": "edward", "nell": "eleanor penelope", "nick": "nicholas", "nico": "nicholas", "nora": "eleanor", "ollie": "oliver",
    "paco": "francisco", "pat": "patricia", "patty": "patricia", "peggy": "margaret", "penny": "penelope", "pete": "peter", "pippa": "philippa", "rafa": "rafael",
    "rick": "richard", "rich": "richard", "rob": "robert", "ron": "ronald", "ros": "rosalind", "roz": "rosalind", "sally": "sarah", "sam": "samuel",
    "sammy": "samuel", "sasha": "alexander", "steve": "stephen", "sue": "susannah", "susie": "susannah", "suzy": "susannah", "ted": "theodore edward", "teddy": "theodore",
    "theo": "theodore", "tim": "timothy", "timmy": "timothy", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "tori": "victoria", "trish": "patricia",
    "uli": "ulrich", "vic": "victor", "vicky": "victoria", "vin": "vincent", "vince": "vincent", "vinny": "vincent", "viv": "genevieve vivian", "walt": "walter", "will": "william",
    "zach": "zachary", "zack": "zachary", "zhenya": "yevgenia",
}

# Short forms that are also common words or syllables: names only with a capital.
ALSO_WORDS = set("art bill bob dan deb dick ed frank fred gen gus hal isa jack jim jo joe kat kit leo max mick mina ned nell nick pat rich rick rob ron ros sam sally sue ted tim tom vic vin will".split())

TITLES = set("dr prof professor judge capt captain col mx mr mrs ms miss sir dame lady lord rev fr herr frau hr fru mme mlle sr sra srta don doña dott sig sig.ra mevr dhr ing mag".split())

ARABIC_GIVEN = set("محمد أحمد علي حسن حسين خالد عمر يوسف إبراهيم سليم رائد نديم ميسم شاهين كريم سامي طارق فارس جمال هاني ليلى مريم فاطمة سارة نور هدى بهنود آرمان مهرنوش رضا مهدی کاوه".split())
CHINESE_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤柳郁闻"
