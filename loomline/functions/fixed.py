"""Fixed values that results depend on: word lists, marker phrases, patterns and weights. Data only."""

# All tables of this module.

STOP_WORDS = (
    "a about above after again against all also although always am an and any are aren't as at be because been before being below between both but by can "
    "can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further get got had hadn't has hasn't have haven't "
    "having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself just know "
    "let's like ll made make me might mightn't more most mustn't my myself no nor not now of off on once only or other ought our ours ourselves out over "
    "own re s same shan't she she'd she'll she's should shouldn't so some such t than that that's the their theirs them themselves then there there's these "
    "they they'd they'll they're they've this those through to too under until up us ve very was wasn't we we'd we'll we're we've were weren't what what's "
    "when when's where where's which while who who's whom why why's will with won't would wouldn't you you'd you'll you're you've your yours yourself "
    "yourselves "
).split()

NEGATORS = ['not', 'no', 'never', 'nothing', 'nowhere', 'neither', 'nobody', 'nor', 'without', 'hardly', 'barely', 'scarcely', "n't", 'cannot', "can't", "won't", "wouldn't",
 "shouldn't", "couldn't", "didn't", "doesn't", "don't", "isn't", "aren't", "wasn't", "weren't"]

INTENSIFIERS = {'extremely': 1.5,
 'very': 1.4,
 'really': 1.3,
 'incredibly': 1.5,
 'absolutely': 1.4,
 'completely': 1.3,
 'totally': 1.3,
 'utterly': 1.4,
 'deeply': 1.3,
 'terribly': 1.3,
 'awfully': 1.3,
 'insanely': 1.4,
 'overwhelmingly': 1.5,
 'profoundly': 1.4,
 'severely': 1.4,
 'immensely': 1.4,
 'tremendously': 1.4,
 'enormously': 1.3,
 'seriously': 1.2,
 'genuinely': 1.2,
 'truly': 1.2,
 'so': 1.2,
 'quite': 1.1}

DIMINISHERS = {'slightly': 0.6,
 'somewhat': 0.7,
 'a bit': 0.7,
 'kind of': 0.7,
 'sort of': 0.7,
 'a little': 0.6,
 'fairly': 0.8,
 'rather': 0.8,
 'mildly': 0.6,
 'partly': 0.7,
 'barely': 0.5,
 'hardly': 0.4,
 'almost': 0.7,
 'nearly': 0.7}

SARCASM_PATTERNS = ['\\bgreat,\\s+just\\s+great\\b', '\\boh,?\\s+great\\b', '\\bwonderful[,.]?\\s+really\\b', '\\bperfect[,.]?\\s+absolutely\\s+perfect\\b',
 '\\blovely[,.]?\\s+just\\s+lovely\\b', '\\bfantastic[,!]\\b(?=.*right\\b)', '\\bsure[,.]?\\s+because\\s+that\\s+makes\\s+sense\\b', '\\boh,?\\s+how\\s+sweet\\b',
 '\\byeah,?\\s+right\\b', '\\bsuddenly\\s+cares\\b', '\\bmy\\s+hero\\b', '\\bthanks\\s+for\\s+nothing\\b', "\\bdon't\\s+flatter\\s+yourself\\b"]

RED_FLAGS = {'Gaslighting': ["\\byou('re|re)?\\s+crazy\\b", "\\bthat\\s+(never|didn't)\\s+happen\\b", "\\byou('re)?\\s+too\\s+sensitive\\b", "\\byou('re)?\\s+overreacting\\b",
                 "\\byou're\\s+imagining\\b", '\\bit\\s+was\\s+(just\\s+a\\s+)?joke\\b', '\\byou\\s+misunderstood\\b', '\\bi\\s+never\\s+said\\s+that\\b',
                 "\\byou('re)?\\s+paranoid\\b", '\\bdream(ed|ing)?\\b.*said\\b'],
 'Control & Isolation': ["\\b(can't|cannot|not\\s+allowed)\\s+(see|talk|go|have)\\b", '\\bwho\\s+(are|were)\\s+you\\s+(talking|texting|seeing)\\b',
                         '\\bgive\\s+(me|us)\\s+your\\s+password\\b', '\\btrack(ing)?\\s+(your|my)\\s+(phone|location)\\b', '\\bcheck(ed|ing)?\\s+my\\s+phone\\b',
                         '\\bisolat(e|ed|ing|ion)\\b', '\\bno\\s+friends\\b', '\\bconstant\\s+check(ing)?\\b'],
 'Emotional Manipulation': ["\\byou('ll|'d)?\\s+be\\s+nothing\\s+without\\s+me\\b", '\\bno\\s+one\\s+(else\\s+)?(will|would|could)\\s+(ever\\s+)?love\\s+you\\b',
                            '\\blook\\s+what\\s+you\\s+(made|make)\\s+me\\s+do\\b', "\\bit('s|s)?\\s+(all\\s+)?your\\s+fault\\b", '\\bguilt\\s+trip(ping)?\\b',
                            '\\bemotional\\s+(abuse|blackmail|manipulation)\\b', '\\bthreat(en|ening|ened)?\\b.*leave\\b',
                            '\\bif\\s+you\\s+(really\\s+)?loved\\s+me\\b'],
 'Narcissistic Patterns': ['\\b(always|everything)\\s+(about|for)\\s+you\\b', '\\bno\\s+empathy\\b', '\\bempathize\\b', '\\bnarciss(ist|istic|ism)\\b',
                           '\\bself.?centered\\b', '\\bself.?absorbed\\b', '\\bselfish\\b', '\\bwhat\\s+about\\s+me\\b',
                           "\\bmy\\s+feelings\\s+(don't|never)\\s+matter\\b", '\\bstep\\s+on\\s+(everyone|others)\\b'],
 'Love Bombing': ['\\bperfect(ly)?\\s+(right|made|suited)\\s+for\\s+(each\\s+other|me|us)\\b', '\\bnever\\s+(felt|had)\\s+this\\s+(before|way)\\b',
                  '\\bfate\\b.*\\btogether\\b', '\\bdestined\\b', '\\bsoulmate\\b.*\\binstantly\\b',
                  '\\bwant\\s+to\\s+(marry|spend\\s+my\\s+life)\\b.*\\b(just|only)\\s+(met|started)\\b', '\\bso\\s+many\\s+gifts\\b', '\\bbombar(d|ding)\\b'],
 'Exit Signals': ["\\bcan't\\s+do\\s+this\\s+anymore\\b", '\\btoo\\s+much\\s+(to\\s+handle|for\\s+me)\\b', '\\bgiving\\s+up\\b', '\\bwalking\\s+away\\b',
                  '\\bmoving\\s+on\\b', '\\blife\\s+without\\s+(you|him|her|them)\\b', '\\bstart\\s+(over|fresh|anew)\\b',
                  "\\bdon't\\s+(want|love)\\s+(this|you)\\s+anymore\\b", '\\bwhat\\s+was\\s+(the\\s+)?point\\b',
                  '\\bshould\\s+have\\s+(left|ended)\\s+(earlier|sooner)\\b']}

ATTACHMENT = {'anxious': ['cling', 'clingy', 'abandon', 'need you', 'terrified of losing', "please don't leave", 'desperately', "scared you'll leave", 'what if you leave', 'beg',
             'begging', 'hysterical', 'checking', 'constant contact', 'reassurance', 'validation'],
 'avoidant': ['space', 'distance', 'independent', 'too much', 'smothered', 'suffocating', 'back off', 'commitment', 'walls', 'cold', 'emotionally unavailable',
              'withdrawn', 'pushing away', "don't need", 'just fine alone', "don't want to talk"],
 'disorganised': ['want you to stay but scared', 'love you but hate you', "don't know what I want", 'pull you in then push away', 'confused', 'chaos',
                  'both comfort and threat', 'freeze', 'dissociate', "can't think straight"],
 'secure': ['talk it out', 'communicate', 'trust each other', 'safe', 'understand each other', 'work through', 'together we', 'secure', 'stable', 'mutual',
            'respect boundaries', 'healthy disagreement', 'space and closeness']}

PAST_MARKERS = '\\b(was|were|had|did|used to|would|could|remembered?|thought|felt|loved?|said|told|went|came|saw|knew|got|made|took|gave|found|lost|left|ended|started|began|became)\\b'

PRESENT_MARKERS = '\\b(is|are|have|has|do|does|feel|love|say|tell|go|come|see|know|get|make|take|give|find|lose|leave|end|start|begin|become|am|try|need|want|think|believe|wish)\\b'

FUTURE_MARKERS = '\\b(will|would|shall|going to|gonna|plan to|hope to|want to|wish I|maybe someday|one day|next|tomorrow|eventually|if only|could be|might be)\\b'

PHASE_MARKERS = {'initialisation': ['first time', 'when we met', 'beginning', 'started dating', 'early days', 'first date', 'just started', 'new relationship'],
 'idealisation': ['perfect', 'honeymoon', 'best time', 'so happy together', "couldn't be happier", 'amazing', 'never been better', 'felt like a dream', 'magical',
                  'everything was perfect'],
 'turbulence': ['first fight', 'started arguing', 'tension', 'problems started', 'things changed', 'something shifted', 'not the same', 'growing apart',
                'cracks appeared'],
 'conflict': ['argument', 'fight', 'screaming', 'shouting', 'breaking point', "couldn't take it", 'had enough', 'ultimatum', 'walked out'],
 'deterioration': ['falling apart', 'gave up', 'not trying', 'distance', 'strangers', 'roommates', 'no connection', 'just existing', 'going through motions', 'hollow'],
 'resolution': ['decided to end', 'broke up', 'divorce', 'separation', 'final conversation', 'closure', 'moving on', 'accept', 'healing', 'new chapter']}

RUMINATION_MARKERS = ['\\bwhy\\s+did\\b', "\\bwhy\\s+didn't\\b", '\\bif\\s+only\\b', '\\bshould\\s+have\\b', '\\bcould\\s+have\\b', '\\bwould\\s+have\\b', '\\bwhat\\s+if\\b',
 '\\bkeep\\s+thinking\\b', "\\bcan't\\s+stop\\s+thinking\\b", '\\bover\\s+and\\s+over\\b', '\\bstuck\\s+on\\b', "\\bcan't\\s+let\\s+go\\b",
 '\\bobsess(ed|ing|ive|ion)\\b', '\\breplay(ing)?\\b', '\\bkeep\\s+replaying\\b', '\\bstill\\s+thinking\\b', "\\bcan't\\s+move\\s+on\\b"]

CONTROL_VERBS = ['control', 'demand', 'force', 'make', 'insist', 'require', 'expect', 'order', 'command', 'tell', 'dictate', 'rule', 'dominate', 'own', 'possess']

SACRIFICE_VERBS = ['sacrifice', 'give up', 'give in', 'concede', 'compromise', 'yield', 'surrender', 'submit', 'comply', 'obey', 'accept', 'tolerate', 'endure']

APOLOGY_WORDS = ['sorry', 'apologise', 'apologize', 'apology', 'forgive', 'forgave', 'my fault', 'my mistake', 'i was wrong', "i'm to blame", 'mea culpa']

INITIATE_VERBS = ['ask', 'reach out', 'text', 'call', 'suggest', 'propose', 'initiate', 'invite', 'start', 'begin', 'contact', 'message', 'approach']

EXIT_SIGNALS = {'Mental Preparation': ['starting to imagine', 'life without you', 'what if i left', 'thinking about leaving', 'picture myself alone', 'plan', 'researching', 'options',
                        'alternative', 'escape'],
 'Emotional Detachment': ["don't feel the same", 'feel nothing', 'checked out', "don't care anymore", 'given up', 'emotionally gone', 'disconnected', 'number', 'hollow',
                          'indifferent', 'numb'],
 'Future Without Partner': ['my own place', 'my own life', 'my plans', 'move out', 'by myself', 'on my own', 'independently', 'solo', 'if i were single', 'without them'],
 'Acceptance of End': ["it's over", "we're done", "can't save this", 'too broken', 'no coming back', 'past the point', 'end is near', 'accept'],
 'Regret of Staying': ["wish i'd left sooner", 'wasted years', 'should have ended', 'stayed too long', 'waste of time', 'could have been happy']}

KEY_RELATIONSHIP_WORDS = ['love', 'trust', 'happy', 'together', 'partner', 'us', 'we', 'home', 'future', 'hope', 'care', 'feel', 'need', 'want', 'stay', 'leave']

ABSOLUTE_PAIRS = [('\\balways\\b', '\\bnever\\b'), ('\\beveryone\\b', '\\bnobody\\b'), ('\\beverything\\b', '\\bnothing\\b'), ('\\ball the time\\b', '\\bnot once\\b'),
 ('\\bevery time\\b', '\\bnot once\\b'), ('\\bconstantly\\b', '\\brarely\\b'), ('\\bperfect\\b', '\\bterrible\\b'), ('\\bcompletely\\b', '\\bnot at all\\b')]

RUMINATION_THEMES = ['pain', 'hurt', 'why', 'loss', 'leave', 'end', 'break', 'fault', 'blame']

HORSEMAN_WEIGHTS = {'criticism': 1.0, 'contempt': 1.3, 'defensiveness': 0.9, 'stonewalling': 1.1}

HORSEMAN_PATTERNS = {'criticism': ['\\byou always\\b', '\\byou never\\b', "\\bwhat's wrong with you\\b", "\\bwhy can't you\\b", "\\byou're so\\b.*\\b(bad|wrong|stupid|lazy)\\b"],
 'contempt': ['\\beyeroll\\b', '\\brolling my eyes\\b', '\\bpathetic\\b', "\\byou're disgusting\\b", '\\bsneer\\b', "\\byou're beneath\\b"],
 'defensiveness': ["\\bit's not my fault\\b", '\\bnot my problem\\b', "\\bi didn't do anything\\b", '\\byou started it\\b', '\\bwhy are you always blaming\\b'],
 'stonewalling': ['\\bnot talking\\b', '\\bsilent treatment\\b', '\\bcold shoulder\\b', '\\bshutting down\\b', '\\btuning out\\b', '\\bwalls up\\b']}

SELF_BLAME_PATTERNS = ['\\bmy fault\\b', '\\bi should\\b', "\\bi didn't\\b", '\\bi failed\\b', '\\bi messed up\\b', '\\bi ruined\\b', "\\bi wasn't\\b", "\\bi couldn't\\b", '\\bmy mistake\\b']

OTHER_BLAME_PATTERNS = ['\\byour fault\\b', '\\byou should\\b', "\\byou didn't\\b", '\\byou failed\\b', '\\byou ruined\\b', "\\byou weren't\\b", '\\byou made me\\b', '\\bbecause of you\\b',
 '\\byou never\\b']

ROLES = ['husband', 'wife', 'partner', 'boyfriend', 'girlfriend', 'ex', 'mother', 'father', 'sister', 'brother', 'friend', 'therapist', 'colleague', 'boss', 'child', 'son',
 'daughter']

TRAUMA_THEMES = {'abandonment': ['leave', 'left', 'abandon', 'alone', 'gone', 'rejected', 'dumped'],
 'betrayal': ['cheat', 'betray', 'lie', 'deceive', 'unfaithful', 'secret', 'hidden'],
 'control': ['control', 'manipulate', 'force', 'demand', 'trapped', 'suffocate'],
 'worthlessness': ['worthless', 'useless', 'failure', 'nothing', 'not enough', 'inadequate'],
 'loneliness': ['lonely', 'alone', 'isolated', 'no one', 'invisible', 'empty'],
 'instability': ['unpredictable', 'volatile', 'chaos', 'walking on eggshells', 'never know'],
 'rejection': ['rejected', 'unwanted', 'unloved', 'not enough', 'push away', 'cold']}

COMMON_CAPS = ['I', 'The', 'A', 'An', 'But', 'And', 'Or', 'So', 'Then', 'When', 'After', 'Before', 'Just', 'Now', 'That', 'This', 'He', 'She', 'We', 'They', 'It', 'In', 'On', 'At']

DISTORTIONS = {'Catastrophising': ['\\b(ruin|ruined|destroyed|end of|never recover|catastroph|worst.*(ever|always)|everything.*fall)',
                     '\\b(disaster|unbearable|devastat|collapse|shatter|fall apart|fall to pieces)'],
 'Black-White Thinking': ['\\b(always|never|every time|all the time|nothing|everything|nobody|everybody|completely|totally|absolutely|100%|zero)\\b',
                          '\\b(perfect|perfectly|not once|without exception|no exception)'],
 'Mind Reading': ['\\b(knows?|knew) (i |me |my |what i|how i|that i)',
                  '\\b(they think|she thinks|he thinks|must think|probably think|obviously think|clearly think|assume.*feel|assume.*know)'],
 'Fortune Telling': ["\\b(will never|won't ever|never going to|it.s over|no point|there.s no|can.t change|won.t change|will always be|nothing will)",
                     '\\b(doomed|inevitable|certain to|bound to fail|destined)'],
 'Personalisation': ['\\b(my fault|because of me|i caused|i made (him|her|them)|i ruined|i destroyed|i broke|i am responsible|blame myself|all my fault)',
                     '\\b(if only i|i should have|i could have|had i not)'],
 'Mental Filter': ['\\b(despite|even though|but still|yet still|nevertheless.*bad|no matter (what|how)|regardless.*negative)',
                   '\\b(yes but|sure but|granted but|i know but|i get it but)'],
 'Overgeneralisation': ['\\b(always happens|keeps happening|every time|pattern|again and again|time after time|once more|once again|yet again|typical|typical of)',
                        '\\b(never works|never changes|nothing ever|always the same)'],
 'Emotional Reasoning': ['\\b(feel (like|that).*(must|is|are|am)|feels? true|feels? real|feelings? tell me|gut says|i just know|instinct says)',
                         '\\b(feel (worthless|stupid|ugly|bad|terrible|awful).*(so|therefore|means|must be))'],
 'Should Statements': ['\\b(should|shouldn.t|must|mustn.t|have to|ought to|supposed to|expected to|need to be|need to have)\\b',
                       '\\b(shouldn.t have|should have|must have|ought to have)'],
 'Labelling': ['\\b(i am (a )?(loser|failure|idiot|stupid|worthless|pathetic|weak|coward|terrible person|bad person|monster|fraud|fake))',
               '\\b(he is|she is|they are).{0,20}(terrible|awful|monster|toxic|narcissist|abuser|manipulat)'],
 'Magnification / Minimisation': ['\\b(huge|massive|enormous|gigantic|terrible|major).{0,20}(mistake|problem|flaw|error|issue)',
                                  '\\b(just a|only a|merely a|tiny|small|little|nothing really|not a big deal|doesn.t matter)'],
 'Jumping to Conclusions': ['\\b(obvious|clearly|obviously|it.s clear|evidently|without a doubt|no doubt|definitely|certainly|must be|has to be|can only mean)',
                            '\\b(what else could|there.s only one|the only explanation|plain as day|anyone can see)']}

ARCHETYPES = {'Tragic Hero': ['sacrifice', 'gave up', 'gave everything', 'worth it', 'deserve', 'loyal', 'faithful', 'alone', 'abandoned', 'left', 'walked out', 'never appreciated',
                 'nothing in return'],
 'Rescuer–Victim': ['fix', 'save', 'help', 'rescue', 'broken', 'damaged', "couldn't help", 'tried to help', 'needed me', 'dependent', 'relied', 'dragged down',
                    'exhausted', "couldn't do it alone"],
 'Push-Pull': ['hot and cold', 'come close', 'push away', 'one minute', 'next minute', 'cycle', 'again', 'back and forth', 'on and off', 'pull me in', 'push me away',
               "couldn't leave"],
 'Mirror Dynamic': ['same', 'both', 'we both', 'just like', 'remind me of', 'mirror', 'reflection', 'recognised', 'saw myself', 'same patterns', 'repeated',
                    'same mistakes'],
 'Idealize–Devalue': ['perfect', 'ideal', 'perfect person', 'thought they were', 'pedestal', 'put on', 'turned out', 'not who i thought', 'changed', 'different person',
                      'mask', 'facade'],
 'Slow Fade': ['slowly', 'drifted', 'grew apart', 'less and less', 'stopped', 'faded', 'distant', 'no longer', 'used to', 'remember when', 'different now', 'silence',
               'nothing left']}

DISCLOSURE_TIERS = {'Deep': (1.0,
          '\\b(ashamed|shame|worthless|unlovable|broken|core|wound|inner|deep inside|fundamentally|identity|who i am|not enough|always been|childhood|never '
          'felt|abandoned as|real me|true self|terrified to|scared to admit)\\b'),
 'Mid': (0.6, '\\b(feel|felt|feeling|emotion|hurt|angry|sad|scared|afraid|lonely|confused|jealous|guilty|embarrassed|upset|anxious|vulnerable)\\b'),
 'Surface': (0.3, '\\b(happened|went|came|said|did|told|asked|left|stayed|came back|she was|he was|they were|we went|i went|i came)\\b')}

VADER_SEEDS = {'good': 1.9,
 'great': 3.1,
 'excellent': 3.2,
 'wonderful': 3.4,
 'fantastic': 3.5,
 'amazing': 3.2,
 'love': 3.0,
 'beautiful': 2.8,
 'happy': 2.9,
 'joy': 2.9,
 'glad': 2.1,
 'nice': 1.8,
 'kind': 2.0,
 'sweet': 2.2,
 'lovely': 2.7,
 'perfect': 3.3,
 'best': 2.5,
 'brilliant': 3.0,
 'awesome': 3.2,
 'super': 2.1,
 'positive': 2.2,
 'trust': 2.3,
 'hope': 2.1,
 'better': 1.5,
 'safe': 1.8,
 'proud': 2.2,
 'excited': 2.4,
 'grateful': 2.5,
 'lucky': 2.0,
 'fun': 2.1,
 'warm': 1.9,
 'care': 1.7,
 'honest': 1.8,
 'gentle': 1.9,
 'bad': -1.9,
 'terrible': -3.1,
 'awful': -3.0,
 'horrible': -3.2,
 'hate': -3.1,
 'angry': -2.8,
 'anger': -2.8,
 'sad': -2.5,
 'sadness': -2.5,
 'fear': -2.3,
 'afraid': -2.5,
 'scared': -2.4,
 'hurt': -2.2,
 'pain': -2.3,
 'broken': -2.7,
 'destroyed': -3.1,
 'betrayed': -2.9,
 'worthless': -2.9,
 'pathetic': -2.8,
 'disgusting': -2.7,
 'disgusted': -2.5,
 'furious': -3.0,
 'rage': -3.1,
 'miserable': -2.9,
 'devastating': -2.9,
 'depressed': -2.8,
 'lonely': -2.4,
 'ashamed': -2.5,
 'failure': -2.7,
 'loser': -2.6,
 'useless': -2.4,
 'helpless': -2.3,
 'hopeless': -2.9,
 'disaster': -2.7,
 'ugly': -2.4,
 'jealous': -2.2,
 'envious': -2.0,
 'bitter': -2.3,
 'cruel': -2.6,
 'selfish': -2.5,
 'toxic': -2.8,
 'abusive': -3.0,
 'manipulative': -2.9,
 'controlling': -2.6,
 'neglect': -2.5,
 'abandon': -2.6,
 'abandoned': -2.8,
 'betrayal': -3.0,
 'liar': -2.9,
 'lie': -2.1,
 'lies': -2.2,
 'cheated': -2.8,
 'cheat': -2.5,
 'ignore': -1.8,
 'ignored': -2.0,
 'ok': 0.3,
 'fine': 0.1,
 'okay': 0.2,
 'neutral': 0.0,
 'average': 0.0,
 'normal': 0.1,
 'sometimes': -0.1,
 'often': 0.1,
 'usually': 0.1,
 'generally': 0.0,
 'mostly': 0.1}

NRC_SEEDS = {'love': ['joy', 'trust', 'positive'],
 'joy': ['joy', 'positive'],
 'happy': ['joy', 'positive'],
 'hope': ['joy', 'anticipation', 'positive'],
 'trust': ['trust', 'positive'],
 'safe': ['trust', 'positive'],
 'care': ['trust', 'joy', 'positive'],
 'faith': ['trust', 'anticipation', 'positive'],
 'kind': ['trust', 'joy', 'positive'],
 'fear': ['fear', 'negative'],
 'scared': ['fear', 'negative'],
 'afraid': ['fear', 'negative'],
 'anxiety': ['fear', 'negative'],
 'panic': ['fear', 'surprise', 'negative'],
 'worried': ['fear', 'negative'],
 'anger': ['anger', 'negative'],
 'angry': ['anger', 'negative'],
 'furious': ['anger', 'negative'],
 'rage': ['anger', 'negative'],
 'hate': ['anger', 'disgust', 'negative'],
 'disgust': ['disgust', 'negative'],
 'contempt': ['disgust', 'anger', 'negative'],
 'jealous': ['anger', 'sadness', 'negative'],
 'sad': ['sadness', 'negative'],
 'sadness': ['sadness', 'negative'],
 'grief': ['sadness', 'negative'],
 'loss': ['sadness', 'negative'],
 'lonely': ['sadness', 'negative'],
 'cry': ['sadness', 'negative'],
 'pain': ['sadness', 'negative'],
 'hurt': ['sadness', 'anger', 'negative'],
 'broken': ['sadness', 'negative'],
 'surprise': ['surprise'],
 'shocked': ['surprise', 'fear'],
 'unexpected': ['surprise'],
 'expect': ['anticipation'],
 'excited': ['anticipation', 'joy', 'positive'],
 'plan': ['anticipation'],
 'future': ['anticipation'],
 'waiting': ['anticipation'],
 'bad': ['negative'],
 'terrible': ['negative'],
 'awful': ['negative'],
 'horrible': ['negative'],
 'good': ['positive'],
 'great': ['positive'],
 'wonderful': ['positive', 'joy'],
 'positive': ['positive'],
 'negative': ['negative'],
 'unhappy': ['sadness', 'negative'],
 'loyal': ['trust', 'positive'],
 'honest': ['trust', 'positive'],
 'liar': ['disgust', 'anger', 'negative'],
 'abandon': ['sadness', 'fear', 'negative'],
 'neglect': ['sadness', 'negative'],
 'cherish': ['trust', 'joy', 'positive'],
 'warmth': ['joy', 'trust', 'positive'],
 'cold': ['sadness', 'negative']}

NRC_EMOTIONS = ['joy', 'trust', 'fear', 'surprise', 'sadness', 'disgust', 'anger', 'anticipation']

LIWC_CATEGORIES = {'Positive Emotion': ['love', 'happy', 'joy', 'glad', 'wonderful', 'nice', 'good', 'great', 'beautiful', 'fun', 'awesome', 'hope', 'gratitude', 'grateful', 'amazing'],
 'Negative Emotion': ['hate', 'angry', 'sad', 'fear', 'terrible', 'awful', 'horrible', 'hurt', 'pain', 'broken', 'betrayed', 'worthless', 'miserable', 'furious', 'rage'],
 'Cognitive Process': ['think', 'know', 'understand', 'realize', 'believe', 'feel', 'wonder', 'mean', 'consider', 'remember', 'thought', 'reason', 'question'],
 'Social Process': ['we', 'us', 'our', 'they', 'them', 'together', 'relationship', 'partner', 'friend', 'family', 'people', 'person', 'conversation', 'talk'],
 'Anxiety': ['fear', 'afraid', 'scared', 'nervous', 'worried', 'panic', 'anxiety', 'dread'],
 'Anger': ['angry', 'hate', 'furious', 'rage', 'irritated', 'frustrated', 'bitter'],
 'Sadness': ['sad', 'grief', 'lonely', 'miss', 'cry', 'devastated', 'depressed', 'hopeless'],
 'Insight': ['realize', 'understand', 'learn', 'figure', 'discover', 'aware', 'see', 'notice']}

CONSTRUCT_PROXIES = {'pti': (['i', 'my', 'me', 'myself', 'mine', "i've", "i'm", "i'd", "i'll"], ['you', 'your', "you've", "you're", "you'd", "you'll", 'we', 'our']),
 'teg': (['suddenly', 'shift', 'swing', 'change', 'different', 'then', 'but then', 'one minute', 'next minute', 'flip', 'unstable', 'volatile', 'sometimes'], []),
 'vads': (['feel', 'felt', 'emotion', 'confess', 'admit', 'share', 'open', 'honest', 'truth', 'real', 'deep', 'core', 'afraid', 'ashamed', 'vulnerable'],
          ['cannot say', 'hard to say', 'difficult to', 'not ready', 'prefer not']),
 'cds': (['worthless', 'hopeless', 'failure', 'empty', 'sad', 'no interest', 'everything', 'nothing', 'never', 'always', 'fault', 'blame', 'pointless'],
         ['hopeful', 'improving', 'better', 'positive', 'look forward']),
 'gase': (['love', 'happy', 'good', 'wonderful', 'lucky', 'together', 'trust', 'safe'], ['hate', 'angry', 'terrible', 'broken', 'betrayed', 'hurt', 'abandoned']),
 'lewi_drop': (['worse', 'declining', 'deteriorating', 'falling apart', 'less', 'distant', 'changed', 'different', 'not the same', 'fell out'],
               ['better', 'improving', 'stronger', 'healing', 'closer', 'growing'])}

RULE_PATTERNS = ['\\b(sorry|apologize|apology)\\b.*\\b(again|again|still|but)\\b', '\\b(forgave|forgive|forgiven)\\b.*\\b(again|same|again)\\b',
 '\\b(everyone|everyone warned|friends warned|family said)\\b', '\\b(kids?|children?|mortgage|house|money|finances)\\b.*\\b(stay|together|trying)\\b',
 '\\b(physical|sex|bedroom|intimate)\\b.*\\b(only|nothing else|all we have)\\b', "\\b(lost myself|don't know who I am|changed for|gave up.*for)\\b",
 "\\b(walking on eggshells|afraid to|scared to|can't say)\\b", '\\b(keep trying|trying so hard|working on it|fighting for)\\b.*\\b(alone|by myself|only one)\\b',
 '\\b(past|ex|before me|her ex|his ex|what happened before)\\b', "\\b(love you but|love them but)\\b.*\\b(enough|can't|don't think)\\b",
 "\\b(don't love|stopped loving|no longer love|fell out of love)\\b", '\\b(my fault|blame myself|should have)\\b',
 '\\b(waited|waiting|gave years|years of my life|wasted)\\b', '\\b(cheated|affair|unfaithful|infidelity)\\b', '\\b(promised|swore|never again|last time|final chance)\\b',
 "\\b(need them|can't live without|fall apart without)\\b", '\\b(grew apart|drifted|not the same|changed)\\b',
 "\\b(communicate|talk|just talk)\\b.*\\b(don't|won't|refuses|can't)\\b"]

WEAK_POS = ['love', 'happy', 'wonderful', 'amazing', 'grateful', 'thankful', 'blessed', 'joy', 'trust', 'hope', 'better', 'healed', 'healing', 'growing', 'good', 'great',
 'beautiful', 'kind', 'supportive', 'caring', 'healthy', 'safe']

WEAK_NEG = ['hate', 'angry', 'hurt', 'betrayed', 'broken', 'destroyed', 'terrible', 'awful', 'horrible', 'worthless', 'abandoned', 'alone', 'lonely', 'scared', 'afraid', 'anxiety',
 'depressed', 'toxic', 'abusive', 'controlling', 'sad', 'devastated', 'hopeless', 'helpless', 'cheated', 'lied', 'manipulated']

WEAK_EMOTIONS = {'anger': ['angry', 'furious', 'rage', 'hate', 'irritated', 'frustrated'],
 'sadness': ['sad', 'grief', 'devastated', 'heartbroken', 'lonely', 'miss', 'cry', 'lost'],
 'fear': ['scared', 'afraid', 'terrified', 'anxious', 'worried', 'panic', 'dread'],
 'joy': ['happy', 'excited', 'grateful', 'wonderful', 'amazing', 'love', 'joy'],
 'trust': ['trust', 'believe', 'reliable', 'honest', 'safe', 'secure', 'faithful'],
 'disgust': ['disgusted', 'repulsed', 'sick', 'gross', 'vile', 'revolted'],
 'surprise': ['shocked', 'surprised', 'unexpected', 'sudden', 'disbelief'],
 'anticipation': ['hope', 'waiting', 'expect', 'planning', 'looking forward']}

WIDE_POS = ['love', 'happy', 'wonderful', 'amazing', 'grateful', 'thankful', 'blessed', 'joy', 'trust', 'hope', 'better', 'healed', 'healing', 'growing', 'good', 'great',
 'beautiful', 'kind', 'supportive', 'caring', 'healthy', 'safe', 'progress', 'moving on', 'stronger', 'recovered', 'cherish']

WIDE_NEG = ['hate', 'angry', 'hurt', 'betrayed', 'broken', 'destroyed', 'terrible', 'awful', 'horrible', 'worthless', 'abandoned', 'alone', 'lonely', 'scared', 'afraid', 'anxiety',
 'depressed', 'toxic', 'abusive', 'controlling', 'sad', 'devastated', 'hopeless', 'helpless', 'cheated', 'lied', 'manipulated', 'narcissist', 'gaslight', 'trauma',
 'ptsd', 'abuse', 'coercive', 'violated']

WIDE_EMOTIONS = {'anger': ['angry', 'furious', 'rage', 'hate', 'irritated'],
 'sadness': ['sad', 'grief', 'devastated', 'lonely', 'miss', 'cry', 'lost', 'heartbroken'],
 'fear': ['scared', 'afraid', 'terrified', 'anxious', 'worried', 'panic'],
 'joy': ['happy', 'excited', 'grateful', 'wonderful', 'love', 'joy'],
 'trust': ['trust', 'believe', 'safe', 'secure', 'faithful', 'honest'],
 'disgust': ['disgusted', 'repulsed', 'sick', 'vile', 'revolted']}

PUNCTUATION = '.,!?;:\'"()[]{}—–-'

# What scored texts of known character must show, as (character, claim, condition on the metric row).
VALIDATION = [
    ('Pure Positive Baseline', 'sentiment > 0', 'sentiment > 0'),
    ('Pure Positive Baseline', 'GASE > 0', 'gase > 0'),
    ('Pure Positive Baseline', 'PTI in [-0.5, 0.5]', 'pti between -0.5 and 0.5'),
    ('Pure Positive Baseline', 'NAVA near 0 (flat arc)', 'abs(nava) < 0.5'),
    ('Pure Positive Baseline', 'CD-index < 0.3', 'cd_index < 0.3'),
    ('Pure Negative Baseline', 'sentiment < 0', 'sentiment < 0'),
    ('Pure Negative Baseline', 'GASE < 0', 'gase < 0'),
    ('Pure Negative Baseline', 'CD-index > 0', 'cd_index > 0'),
    ('Pure Negative Baseline', 'VADS > 0.2', 'vads > 0.2'),
    ('Tragic Arc', 'NAVA > 0 (tragic)', 'nava > 0'),
    ('Tragic Arc', 'LEWI drop < 0', 'lewi_drop < 0'),
    ('Tragic Arc', 'TEG > 0.05', 'teg > 0.05'),
    ('High PTI', 'PTI > 0.3 (I-dominant)', 'pti > 0.3'),
    ('High Cognitive Distortion', 'CD-index > 0.4', 'cd_index > 0.4'),
    ('High Cognitive Distortion', 'VADS > 0.3', 'vads > 0.3'),
    ('High Contradiction', 'TIES > 0', 'ties > 0'),
    ('Random Baseline', '|sentiment| < 0.3', 'abs(sentiment) < 0.3'),
    ('Random Baseline', 'GASE near 0', 'abs(gase) < 0.5'),
    ('Random Baseline', 'CD-index < 0.2', 'cd_index < 0.2'),
]

# Fixed value: a negation that may reach a positive word beyond the window of four tokens.
LONG_NEGATION = '\\b(no[nt]|never|nobody|nothing)\\b.*\\b(love|happy|good|trust)\\b'
