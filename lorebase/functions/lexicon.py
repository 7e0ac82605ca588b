"""Word lists and tables that decide labels and scores."""

# These lists and tables must be as they are for right results.

OCR_PAIRS = (('Donot', 'Do not'), ('donot', 'do not'), ('Itis', 'It is'), ('itis', 'it is'), ('isnot', 'is not'), ('arenot', 'are not'),
 ('isnotrecommended', 'is not recommended'), ('canaccidentally', 'can accidentally'), ('accidentallychoke', 'accidentally choke'),
 ('chokethechild', 'choke the child'), ('chokethechildorgiveanelectricalshock', 'choke the child or give an electrical shock'),
 ('giveanelectricalshock', 'give an electrical shock'), ('electricalshock', 'electrical shock'), ('electricalshock.', 'electrical shock.'),
 ('poweroutlet', 'power outlet'), ('thepoweroutlet', 'the power outlet'), ('thepower', 'the power'), ('theback-up', 'the back-up'),
 ('thecamera', 'the camera'), ('arebased', 'are based'), ('Usenon', 'Use non'), ('tocleanany', 'to clean any'), ('sup ply', 'supply'),
 ('beforesetting', 'before setting'), ('anyhome-made', 'any home-made'), ('orback-upbattery', 'or back-up battery'), ('thebattery', 'the battery'),
 ('fireorwater', 'fire or water'), ('orwater', 'or water'), ('fireor', 'fire or '), ('preventafire', 'prevent a fire'),
 ('togetherwith', 'together with'), ('Beforeusing', 'Before using'), ('beforeusing', 'before using'),
 ('Connectthepowercord', 'Connect the power cord'), ('thepowercord', 'the power cord'), ('intoplace', 'into place'), ('maybecome', 'may become'),
 ('physicianimmediately', 'physician immediately'), ('insulationandcauseafire', 'insulation and cause a fire'),
 ('oraccessorywhennot', 'or accessory when not'), ('Electromagneticwaves', 'Electromagnetic waves'),
 ('nottwistortiethecords', 'not twist or tie the cords'), ('thesurroundingisdusty', 'the surrounding is dusty'),
 ('darkroomorchemical', 'darkroom or chemical'), ('technologywithover', 'technology with over'), ('activepixels', 'active pixels'),
 ('deadpixels', 'dead pixels'), ('amongtheremaining', 'among the remaining'),
 ('canwarpthecardsandmakethemunusable', 'can warp the cards and make them unusable'), ('alsocompatiblewith', 'also compatible with'),
 ('turnsoffautomaticaly', 'turns off automatically'), ('turnsoffautomatically', 'turns off automatically'),
 ('automaticallyafterasettimeofidleoperation', 'automatically after a set time of idle operation'),
 ('justpresstheshutterbuttonhalfwaytoturnitonagain', 'just press the shutter button halfway to turn it on again'),
 ('lithiumbatteryasdescribedbelow', 'lithium battery as described below'),
 ('closeanditmaydamagetheshuttercurtainsandimagesensor', 'close and it may damage the shutter curtains and image sensor'),
 ('aresetautomaticallytosuit', 'are set automatically to suit'), ('besettoobtainthebestresults', 'be set to obtain the best results'),
 ('themeteringmodewillbesetto', 'the metering mode will be set to'), ('themeteringmodewillbeset', 'the metering mode will be set'),
 ('theAFmodewillbeset', 'the AF mode will be set'), ('modessimultaneously', 'modes simultaneously'),
 ('JPEGformatscannotbeselected', 'JPEG formats cannot be selected'), ('processingparameters', 'processing parameters'),
 ('numberofpossibleshotswillbehigher', 'number of possible shots will be higher'), ('temperaturereading', 'temperature reading'),
 ('willshowthebiasdirectionand', 'will show the bias direction and'), ('onthewhitebalancemode', 'on the white balance mode'),
 ('whitebalancebracketing', 'white balance bracketing'), ('downtheshutterbutton', 'down the shutter button'),
 ('effectiveforbacklitsubjects', 'effective for backlit subjects'), ('properlybytheflash', 'properly by the flash'),
 ('cameraisclosertothesubject', 'camera is closer to the subject'), ('autoflashwithmultiple', 'auto flash with multiple'),
 ('Sinceconnectioncords', 'Since connection cords'), ('synccordregardlessofitspolarity', 'sync cord regardless of its polarity'),
 ('thecapacityindicatedon', 'the capacity indicated on'), ('automaticallyafteryouresolvetheproblem', 'automatically after you resolve the problem'),
 ('imagewasrecomposed', 'image was recomposed'), ('individuallyforeachimage', 'individually for each image'),
 ('yourselfdependingon', 'yourself depending on'), ('Thischapterexplainshowtousethe', 'This chapter explains how to use the'),
 ('OThelensfocusmodeswitch', 'The lens focus mode switch'), ('ThisaccommodatestwoBP', 'This accommodates two BP'),
 ('TROUBLEHSOOTINGvacuum', 'TROUBLESHOOTING vacuum'),
 ('inwaterorifwaterormetalfragmentsenterinsidethe', 'in water or if water or metal fragments enter inside the'),
 ('Slensmountindexandtur', 'lens mount index and turn'), ('Slensmountindexandturn', 'lens mount index and turn'),
 ('camerabacktoproceedto', 'camera back to proceed to'), ('cannotbesetforboththeB', 'cannot be set for both the B'),
 ('whiteimagesontotheCFcard', 'white images onto the CF card'), ('maketheimagelookmoreimpressive', 'make the image look more impressive'),
 ('camerawilldetectthe', 'camera will detect the'), ('detectionistwiceassensitiveashorizontal', 'detection is twice as sensitive as horizontal'),
 ('eightAFpointsarehorizontal', 'eight AF points are horizontal'), ('linesensitiveorvertical', 'line sensitive or vertical'),
 ('speedoraperturevalueto', 'speed or aperture value to'), ('Customwhitebalanceselection', 'Custom white balance selection'),
 ('indicatesththexposrelevelis', 'indicates that the exposure level is'), ('thedesireddepthoffield', 'the desired depth of field'),
 ('Speedlitesprovidesall', 'Speedlites provides all'), ('tomakesureitsynchronizesproperlywiththe', 'to make sure it synchronizes properly with the'),
 ('whichhasbeenwrittento', 'which has been written to'), ('Transmissionsbetweenthe', 'Transmissions between the'),
 ('Printerscapableofdirectprintingfrom', 'Printers capable of direct printing from'),
 ('andtheimagesspecifiedfortheprintordermight', 'and the images specified for the print order might'),
 ('currentshutterspeedoraperturebecomesunsuitable', 'current shutter speed or aperture becomes unsuitable'),
 ('automaticallytoobtaina', 'automatically to obtain a'), ('thisremoteswitchhas', 'this remote switch has'),
 ('SIRwithaCMOSsensor', 'SLR with a CMOS sensor'), ('Space atleast', 'Space at least'), ('was her', 'washer'), ('thendrain', 'then drain'),
 ('orwax', 'or wax'))

CHUNK_DOMAINS = {'boat': ('boat', 'sailing', 'anchor light', 'bimini top', 'bilge pump', 'engine compartment', 'watercraft', 'jet thrust', 'stern', 'bow', 'hull',
          'battery switch', 'wet storage'),
 'ereader': ('e reader', 'e-reader', 'e-book reader', 'ebook', 'voice recording', 'photo viewer', 'photo mode', 'browser history', 'main menu'),
 'vacuum': ('vacuum', 'home base', 'full bin', 'side brush', 'caster wheel', 'dual-mode virtual wall', 'dust bin', 'room ba', 'cleaning head module',
            'roomba', 'dirt detect'),
 'motherboard': ('motherboard', 'tpm connector', 'pci express', 'cpu', 'system memory', 'raid', 'rear panel connectors', 'onboard led', 'bios',
                 'sata', 'usb 3.1', 'intel lan', 'serial port', 'apm configuration', 'erp ready', 'pxe option', 'configuration options'),
 'airfryer': ('air fryer', 'airfryer', 'nutriu', 'favorite recipe', 'remote cooking', 'basket', 'hot air', 'rapid air', 'keep warm', 'smart chef',
              'air fry'),
 'pressure_cooker': ('pressure cooker', 'quick release', 'float valve', 'steam release', 'anti-block shield', 'condensation collector',
                     'sealing ring'),
 'microwave': ('microwave', 'over-the-range', 'auto defrost', 'grease filter', 'charcoal filter', 'oven light', 'light timer'),
 'snowmobile': ('snowmobile', 'throttle cable', 'v-belt', 'spark plug', 'brake lever', 'ski', 'vk540', 'suspension', 'spring preload', 'fresh snow',
                'fuel tank', 'rider'),
 'landline': ('landline', 'base station', 'handset', 'answering machine', 'phonebook'),
 'camera': ('camera', 'lens', 'shutter', 'viewfinder', 'autofocus', 'battery grip', 'eos', 'mode dial', 'cf card', 'image playback',
            'battery charger', 'lcd panel', 'white balance', 'aperture', 'exposure', 'metering', 'flash', 'iso speed', 'picture style', 'shooting',
            'image-recording', 'date/time battery'),
 'lawn_mower': ('lawn mower', 'mower deck', 'blade-control switch', 'height-of-cut', 'grass deflector', 'spark-plug', 'parking brake',
                'cutting blade', 'anti-scalp', 'pto'),
 'coffee_machine': ('coffee', 'espresso', 'lungo', 'capsule', 'descaling', 'water tank', 'coffee preparation', 'drip tray', 'milk frother'),
 'fax': ('fax', 'telephone line cord', 'phone line', 'mfc-', 'ink cartridge', 'document feeder', 'scanner glass', 'brother', 'telephone wall jack'),
 'toothbrush': ('toothbrush', 'brush head', 'brushing', 'pressure sensor', 'brush pacer', 'senseiq', 'gum', 'bristles', 'toothpaste'),
 'grill': ('grill', 'grilling', 'burner', 'cooking surface', 'grease tray', 'spider alert', 'propane', 'bristle brush'),
 'earphone': ('earphone', 'earphones', 'earbud', 'earbuds', 'charging case', 'bluetooth', 'noise canceling', 'pairing', 'wearing the headset'),
 'television': ('television', 'tv', 'hdmi', 'remote control', 'channel', 'picture mode', 'screen', 'antenna', 'audio output'),
 'washing_machine': ('washer', 'washing machine', 'washtub', 'wash timer', 'spin timer', 'drain filter', 'overflow filter', 'drain hose', 'rinse',
                     'cycle selector', 'water supply')}

PROCEDURE = ('install', 'remove', 'replace', 'clean', 'set ', 'setting', 'connect', 'adjust', 'operate', 'use ', 'using', 'charge', 'recharge', 'pair',
 'assemble', 'mount', 'detach', 'insert', 'plug', 'unplug', 'press', 'select', 'turn on', 'turn off', '安装', '拆卸', '拆下', '更换', '清洁', '设置', '连接', '调节',
 '操作', '使用', '充电', '佩戴', '扣紧', '打开', '关闭', '插入', '选择')

SAFETY = ('warning', 'caution', 'danger', 'safety', 'safeguards', 'risk of', 'do not', 'never', 'avoid', 'hazard', '注意', '警告', '危险', '小心', '安全')

TROUBLE = ('troubleshooting', 'problem', 'error', 'fault', 'fails', 'not working', 'does not', 'cannot', "can't", 'flashing', 'blinking', 'indicator', 'beep',
 'alarm', '故障', '错误', '报错', '无法', '不能', '不工作', '闪烁', '指示灯', '蜂鸣')

PARTS = ('nomenclature', 'overview', 'parts', 'included', 'accessories', 'package contents', 'item check list', 'components', '部件', '零件', '清单', '包装', '组成',
 '配件')

SPECIFICATION = ('specifications', 'technical data', 'dimensions', 'weight', 'battery life', 'capacity', 'temperature range', 'default', 'factory setting', 'rating',
 'model', '规格', '参数', '尺寸', '重量', '容量', '默认', '出厂', '型号', '密码')

STOP_ZH = ('的', '了', '在', '是', '我', '有', '和', '就', '不', '人', '都', '一', '一个', '上', '也', '很', '到', '说', '要', '去', '你', '会', '着', '没有', '看', '好', '自己', '这', '他',
 '她', '它', '吗', '什么', '怎么', '怎样', '如何', '请问', '能', '可以', '吧', '呢', '啊', '那', '这个', '那个', '哪', '哪个', '多少', '为什么', '谁', '请', '帮', '告诉', '一下', '关于',
 '需要', '是否', '哪些')

STOP_EN = ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'before', 'can', 'could', 'do', 'does', 'for', 'from', 'how', 'i', 'if', 'in', 'into', 'is', 'it', 'me',
 'my', 'of', 'on', 'or', 'should', 'the', 'this', 'to', 'use', 'using', 'want', 'what', 'when', 'where', 'while', 'with', 'after', 'about', 'please',
 'tell', 'need', 'first', 'time', 'you', 'your', 'that', 'they', 'them', 'their', 'its', 'has', 'have', 'had', 'been', 'was', 'were', 'will', 'would',
 'may', 'might', 'shall', 'not', 'but', 'also', 'some', 'any', 'all', 'each', 'every', 'both', 'there', 'here', 'then', 'than', 'more', 'most',
 'very', 'much', 'just', 'only', 'even', 'still', 'well', 'too', 'so', 'such', 'which', 'who', 'whom', 'whose', 'other')

DOMAIN_PHRASES = ('指示灯', '闪烁', '标识', '充电', '充电器', '电池组', '表带', '尺寸', '更换', '安装', '维修', '故障', '清洁', '连接', '设置', '显示', '程序', '控制台', '佩戴', '模式', '温度', '延迟', '开机', '关机',
 '按键', '默认密码', '安全注意事项', '注意事项', '售后', '保修')

SYNONYMS = {'红灯': ('指示灯', '闪烁'),
 '蓝灯': ('指示灯',),
 '绿灯': ('指示灯',),
 '灯闪': ('指示灯', '闪烁'),
 '腕带': ('表带', '健身追踪器'),
 '带子': ('表带',),
 '大小': ('尺寸',),
 '配对': ('连接',),
 '连不上': ('连接', '故障'),
 '连不上网': ('连接', '故障'),
 '充满电': ('充电', '电池组'),
 '没电': ('电池', '充电'),
 '重置': ('设置',),
 '密码': ('默认密码',),
 'pin': ('密码', '设备锁'),
 'pin码': ('密码', '设备锁'),
 'pin code': ('密码', '设备锁'),
 '死机': ('故障',),
 '卡住': ('故障',),
 '发热': ('温度',),
 '过热': ('延迟', '温度'),
 '拆卸': ('更换', '安装')}

TITLE_BOOSTS = ((('安全注意事项', '注意事项', '佩戴'), ('安全', '注意', '警告'), 5.0), (('安装', '更换', '拆卸'), ('安装', '组装', '更换'), 4.5), (('充电', '电池组', '充满电'), ('充电', '电池', '电池组'), 4.5),
 (('尺寸', '表带', '腕带'), ('尺寸', '表带'), 4.0), (('默认密码', '密码', '重置', 'pin'), ('密码', '默认密码', 'pin', '设备锁', '重置'), 4.0),
 (('连接', '配对', '连不上'), ('连接', '接口', '配对'), 4.0))

QUERY_DOMAINS = {'boat': ('boat', 'sailing', 'onboard', 'on board', 'anchor', 'jet wash', 'steering', 'starboard', 'port side', 'bow', 'stern', 'hull',
          'engine compartment', 'emission control', 'storage compartment', 'wet storage', 'watercraft'),
 'camera': ('camera', 'lens', 'shutter', 'viewfinder', 'battery grip', 'autofocus', 'af mode', 'aperture', 'iso', 'flash photography',
            'image playback', 'dc coupler', 'eos'),
 'airfryer': ('air fryer', 'airfryer', 'nutriu', 'preset', 'keep warm', 'basket', 'hot air', 'remote cooking', 'wifi', 'voice control', 'food table'),
 'ereader': ('e reader', 'ereader', 'e-book reader', 'ebook', 'voice recording', 'photo viewer', 'photo mode', 'browser history', 'record',
             'main menu'),
 'vacuum': ('vacuum', 'vacuum cleaner', 'home base', 'full bin', 'side brush', 'caster wheel', 'dual-mode virtual wall', 'dust bin', 'roomba'),
 'motherboard': ('motherboard', 'tpm connector', 'pci express', 'cpu', 'system memory', 'raid', 'rear panel connectors', 'onboard led', 'bios',
                 'sata', 'usb 3.1', 'intel lan', 'serial port', 'apm configuration', 'erp ready', 'pxe option'),
 'pressure_cooker': ('pressure cooker', 'quick release', 'float valve', 'steam release', 'anti-block shield', 'condensation collector',
                     'sealing ring'),
 'microwave': ('microwave', 'over-the-range', 'auto defrost', 'grease filter', 'charcoal filter', 'oven light', 'light timer'),
 'snowmobile': ('snowmobile', 'throttle cable', 'v-belt', 'spark plug', 'brake lever', 'ski', 'vk540', 'suspension', 'spring preload', 'fresh snow',
                'fuel tank', 'rider'),
 'landline': ('landline', 'base station', 'handset', 'answering machine', 'phonebook'),
 'lawn_mower': ('lawn mower', 'mower deck', 'blade-control switch', 'height-of-cut', 'grass deflector', 'spark-plug', 'parking brake',
                'cutting blade', 'pto'),
 'coffee_machine': ('coffee', 'espresso', 'lungo', 'capsule', 'descaling', 'water tank', 'coffee preparation', 'drip tray', 'milk frother'),
 'fax': ('fax', 'telephone line cord', 'phone line', 'mfc-', 'ink cartridge', 'document feeder', 'scanner glass', 'telephone wall jack'),
 'toothbrush': ('toothbrush', 'brush head', 'brushing', 'pressure sensor', 'brush pacer', 'senseiq', 'gum', 'bristles', 'toothpaste'),
 'grill': ('grill', 'grilling', 'burner', 'cooking surface', 'grease tray', 'spider alert', 'propane', 'bristle brush'),
 'earphone': ('earphone', 'earphones', 'earbud', 'earbuds', 'charging case', 'bluetooth', 'noise canceling', 'pairing'),
 'television': ('television', 'tv', 'hdmi', 'remote control', 'channel', 'picture mode', 'screen', 'antenna', 'audio output'),
 'washing_machine': ('washer', 'washing machine', 'washtub', 'wash timer', 'spin timer', 'drain filter', 'overflow filter', 'drain hose', 'rinse',
                     'cycle selector')}

INTENT_HINTS = {'procedure': ('怎么', '如何', '步骤', '方法', '安装', '更换', '拆卸', '清洁', '设置', '连接', '操作', '使用', '充电', '佩戴', '调节', 'how', 'procedure', 'install', 'replace',
               'remove', 'clean', 'set', 'connect', 'use', 'charge'),
 'safety_warning': ('安全', '注意', '警告', '危险', '风险', '禁忌', '注意事项', 'safety', 'warning', 'caution', 'danger', 'risk', 'avoid'),
 'troubleshooting': ('故障', '错误', '报错', '无法', '不能', '不工作', '闪烁', '指示灯', '蜂鸣', '失败', 'troubleshoot', 'problem', 'error', 'fault', 'fails',
                     'not working', 'flashing', 'blinking', 'indicator'),
 'parts_list': ('部件', '零件', '配件', '组成', '包含', '包装', '清单', 'parts', 'accessories', 'components', 'included', 'overview'),
 'specification': ('规格', '参数', '尺寸', '重量', '容量', '默认', '密码', '型号', '温度', 'specification', 'dimensions', 'weight', 'capacity', 'default', 'model')}

QUERY_ALIASES = {'battery conversion': ('battery switches', 'battery switch assembly', 'emerg parallel'),
 'battery switching': ('battery switches', 'battery switch assembly'),
 'record voice': ('voice recording', 'record mode'),
 'voice record': ('voice recording', 'record mode'),
 'photo viewer': ('photo mode', 'photo rotation', 'previous or next photo')}

PRODUCTS = {'vr头显': 'VR头显',
 '头显': 'VR头显',
 'ps vr': 'VR头显',
 '人体工学椅': '人体工学椅',
 '椅子': '人体工学椅',
 '办公椅': '人体工学椅',
 '健身单车': '健身单车',
 '单车': '健身单车',
 '动感单车': '健身单车',
 '健身追踪器': '健身追踪器',
 '追踪器': '健身追踪器',
 '手表': '健身追踪器',
 '腕表': '健身追踪器',
 '腕带': '健身追踪器',
 '表带': '健身追踪器',
 '儿童电动摩托车': '儿童电动摩托车',
 '电动摩托车': '儿童电动摩托车',
 '冰箱': '冰箱',
 '功能键盘': '功能键盘',
 '键盘': '功能键盘',
 '发电机': '发电机',
 '可编程温控器': '可编程温控器',
 '温控器': '可编程温控器',
 '吹风机': '吹风机',
 '摩托艇': '摩托艇',
 '水泵': '水泵',
 '洗碗机': '洗碗机',
 '烤箱': '烤箱',
 '电钻': '电钻',
 '冲击钻': '电钻',
 '起子': '电钻',
 '电动工具': '电钻',
 '相机': '相机',
 '空气净化器': '空气净化器',
 '净化器': '空气净化器',
 '空调': '空调',
 '蒸汽清洁机': '蒸汽清洁机',
 '清洁机': '蒸汽清洁机',
 '蓝牙激光鼠标': '蓝牙激光鼠标',
 '鼠标': '蓝牙激光鼠标',
 'jetski': '汇总英文',
 'jet ski': '汇总英文',
 'watercraft': '汇总英文',
 'boat': '汇总英文',
 'airfryer': '汇总英文',
 'air fryer': '汇总英文',
 'vacuum': '汇总英文',
 'vacuum cleaner': '汇总英文',
 'lawn mower': '汇总英文',
 'snowmobile': '汇总英文',
 'motherboard': '汇总英文',
 'microwave': '汇总英文',
 'pressure cooker': '汇总英文',
 'earphone': '汇总英文',
 'earphones': '汇总英文',
 'ereader': '汇总英文',
 'e-reader': '汇总英文',
 'e reader': '汇总英文',
 'fax': '汇总英文',
 'grill': '汇总英文',
 'toothbrush': '汇总英文',
 'coffee machine': '汇总英文',
 'landline': '汇总英文',
 'camera': '汇总英文',
 'washer': '汇总英文',
 'washing machine': '汇总英文'}

SERVICE_TERMS = ('退货', '换货', '退换货', '退款', '运费', '物流', '快递', '发票', '发货', '补发', '签收', '售后', '投诉', '赔偿', '订单', '取消订单', '二手', '假货', '划痕', '破损', '瑕疵', '少了一件', '少件', '开发票',
 '抬头', '保修卡', '保障卡', '保质期', '乡镇', '寄到国外', '国外', '配送', '上门取件', '到账', '信用卡', '原路返回', '包装盒', '包装破损', '维修费用', '维修服务', '补偿', '虚假宣传', '联系客服', '人工客服',
 '智能客服', '售后服务', '改地址', '修改地址', '收货地址', '预约安装', '安装服务', '上门安装', '保价', '价保', '降价', '支付失败', '付款失败', '扣款', '重复扣款', '支付异常', '催发货', '不发货', '延迟发货', '发货慢',
 '保修期', '质保期', '配件', '附件', '补寄配件')

MANUAL_TERMS = ('安装', '充电', '指示灯', '闪烁', '故障', '表带', '尺寸', '更换', '连接', '设置', '说明书', '默认密码', '安全注意事项', '开机', '关机', '按键', '模式', '屏幕', '接口', '电池', '程序', '钻孔', '佩戴',
 '清洁', '保养', '组装')

FOLLOW_UP = ('这个', '这个呢', '那个', '它', '它的', '该设备', '这台设备', '刚才', '上面', '继续', '另外', '还有', '那', '那它', '那这个', '那么', '然后', '接着')

RESET = ('清空上下文', '清除上下文', '重置上下文', '重新开始', '从头开始', '新会话', '忘掉刚才', '不用刚才', '不要参考上文')

SWITCH = ('换个产品', '换一个产品', '另一个产品', '其他产品', '别的产品', '不是这个', '不是刚才', '不问这个', '不问刚才', '换个设备', '换一台设备')

SUB_INTENTS = ('退货', '换货', '退款', '发票', '投诉', '运费', '物流', '维修', '安装', '设置', '清洁', '保修', '充电', '指示灯', '尺寸', '表带', '密码', '注意事项')

SERVICE_FOLLOW_UP = ('那', '还', '还有', '需要', '准备', '材料', '多久', '几天', '怎么办', '可以吗', '能不能', '怎么申请', '怎么处理', '流程', '凭证', '证明', '谁承担', '联系谁', '审核', '下一步', '然后呢')

VISUAL_NOISE = ('图片', '图像', '画面', '设备', '这个', '那个', '其中', '一个', '一些', '可能', '显示', '看到', '部分', '区域', '部件', '位置', '东西', '起来', '相关', '用户', '上传', '内容', '信息', '里的', '中的',
 '具有', '通过', '可以', '用于', '以及', '还有', '这张', '该图像', '该设备', '一个电子设备', '电子', '电子设备')

VISUAL_DOMAIN = ('指示灯', '按钮', '接口', '屏幕', '电池', '充电', '开关', '表带', '卡扣', '旋钮', '插槽', '线缆', '红灯', '蓝灯', '闪烁', '裂纹', '破损', '划痕')

VISUAL_COMPONENT = ('指示灯', '按钮', '接口', '屏幕', '电池', '充电器', '电池组', '开关', '表带', '卡扣', '旋钮', '插槽', '线缆', '显示屏', '端口', '插头')

VISUAL_STATUS = ('红灯', '蓝灯', '绿灯', '闪烁', '发亮', '熄灭', '松动', '脱落', '安装', '拆卸', '充电', '断开', '连接', '锁定', '卡住')

VISUAL_ISSUE = ('裂纹', '破损', '划痕', '烧焦', '变形', '故障', '报警', '漏水', '异响', '发热', '过热', '污渍')

DETAIL_INTENTS = (('materials', ('材料', '资料', '凭证', '截图', '证明', '准备什么', '需要什么', '提供什么')), ('timeline', ('多久', '几天', '多长时间', '什么时候', '何时', '多快', '时效')),
 ('fees', ('收费', '费用', '多少钱', '运费', '免费', '要钱', '花钱')), ('eligibility', ('可以吗', '能不能', '是否支持', '条件', '符合', '满足', '能否', '还能')),
 ('process', ('怎么办', '怎么处理', '流程', '怎么申请', '如何申请', '步骤', '怎么走')), ('contact', ('联系谁', '找谁', '人工客服', '客服电话', '找哪个部门')))
