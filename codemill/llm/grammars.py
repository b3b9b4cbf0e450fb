"""Grammars of six languages, and the tables that drive their parsers.

Each grammar is written as productions, from which SLR(1) tables are built once a process. Where a state can both shift and
reduce it shifts; operators need no levels, as only membership in the language is asked for. Words in lower case and signs
are terminals as the lexers of parsing.py name them.
"""

from __future__ import annotations

from functools import lru_cache

JSON = """
start : value
value : STR | NUM | LIT | { members } | { } | [ values ] | [ ]
members : member | members , member
member : STR : value
values : value | values , value
"""

_SCRIPT = """
start : stmts
stmts : | stmts stmt
stmt : block | ; | expr ; | VAR decls ; | func | class_ | import_ | export_ | if_ | loop | jump | try_ | switch_ | label stmt | typing
label : NAME :
block : { stmts }
decls : decl | decls , decl
decl : target of_type | target of_type = asg
target : NAME | O{ props } | [ items ]
of_type : | : type | OPT type | BANG : type
if_ : if ( expr ) stmt | if ( expr ) stmt else stmt
loop : while ( expr ) stmt | do stmt while ( expr ) ; | do stmt while ( expr ) | for ( for_init ; opt ; opt ) stmt | for ( VAR target OF asg ) stmt | for ( expr OF asg ) stmt | for ( VAR target in expr ) stmt | for await ( VAR target OF asg ) stmt
for_init : | VAR decls | expr
opt : | expr
jump : return ; | return expr ; | break ; | break NAME ; | continue ; | continue NAME ; | throw expr ; | debugger ;
try_ : try block catches
catches : catch ( target of_type ) block | catch block | catch ( target of_type ) block finally block | catch block finally block | finally block
switch_ : switch ( expr ) { cases }
cases : | cases case expr : stmts | cases default : stmts
func : fhead NAME tparams sig fbody
fhead : function | ASYNC function | function MUL | ASYNC function MUL
fbody : block | ;
sig : ( ) result | ( params ) result | ( params , ) result
result : | : type
params : param | params , param
param : mods target of_type | mods target of_type = asg | DOTS target of_type
mods : | mods MOD
tparams : | G< targs G>
targs : targ | targs , targ
targ : type | NAME extends type | type = type
class_ : class NAME tparams heritage cbody | class heritage cbody
heritage : | heritage extends unary | heritage IMPLEMENTS types
types : type | types , type
cbody : { members }
members : | members member
member : ; | mname sig block | mname sig ; | mname G< targs G> sig block | mname of_type ; | mname of_type = asg ; | static block | decorator
mname : key | MUL key | mname key
key : NAME | STR | NUM | [ asg ] | MOD | static | PRIVATE
decorator : AT
expr : asg | expr , asg
asg : cond | unary ASSIGN asg | unary = asg | arrow | yield | yield asg | yield MUL asg
arrow : NAME ARROW abody | ASYNC NAME ARROW abody | A( ) result ARROW abody | A( params ) result ARROW abody | A( params , ) result ARROW abody | ASYNC A( ) result ARROW abody | ASYNC A( params ) result ARROW abody | G< targs G> A( params ) result ARROW abody
abody : { stmts } | asg
cond : bin | bin ? asg : asg
bin : unary | bin BIN bin | bin PM bin | bin MUL bin | bin in bin | bin < bin | bin > bin | bin > > bin | bin > > > bin | bin AS type
unary : post | PRE unary | PM unary | INC unary | BANG unary | await unary
post : prim | post INC
prim : NAME | NUM | STR | REGEX | LIT | ( expr ) | [ items ] | O{ props } | prim . NAME | prim . PRIVATE | prim QDOT NAME | prim QDOT ( args ) | prim QDOT [ expr ] | prim ( args ) | prim [ expr ] | prim STR | prim BANG | prim G< targs G> | new prim | func_ | class_ | import ( args )
func_ : fhead NAME tparams sig block | fhead tparams sig block
args : | items_ | items_ ,
items_ : item | items_ , item
item : asg | DOTS asg
items : | items_ | elisions items_ | items_ elisions | elisions | items_ elisions items_
elisions : , | elisions ,
props : | props_ | props_ ,
props_ : prop | props_ , prop
prop : mname : asg | mname | mname = asg | mname sig block | DOTS asg
import_ : import STR ; | import imported FROM STR ; | import TYPE imported FROM STR ;
imported : NAME | bound | NAME , bound
bound : O{ } | O{ specs } | O{ specs , } | MUL AS NAME
specs : spec | specs , spec
spec : word | word AS word | TYPE word
word : NAME | default | STR
export_ : export func | export class_ | export VAR decls ; | export typing | export default func_ | export default class_ | export default asg ; | export O{ specs } ; | export O{ } ; | export O{ specs , } ; | export O{ specs } FROM STR ; | export O{ specs , } FROM STR ; | export MUL FROM STR ; | export MUL AS NAME FROM STR ; | export = asg ;
"""

_NO_TYPES = "typing : NEVER\ntype : NEVER\n"

_TYPES = """
typing : INTERFACE NAME tparams extended tbody | TYPE NAME tparams = type ; | ENUM NAME { enumerators } | DECLARE stmt | ABSTRACT class_ | NAMESPACE qualified block | const ENUM NAME { enumerators }
qualified : NAME | STR | qualified . NAME
extended : | extends types
tbody : { tmembers }
tmembers : | tmembers tmember
tmember : tsign ; | tsign , | ;
tsign : mname of_type | mname tparams sig | sig | tparams sig | [ NAME : type ] of_type | [ NAME in type ] of_type | new sig
enumerators : | enums | enums ,
enums : enumerator | enums , enumerator
enumerator : NAME | NAME = asg | STR = asg
type : union | union extends union ? type : type | A( ) ARROW type | A( params ) ARROW type | G< targs G> A( params ) ARROW type | new A( params ) ARROW type
union : tunary | union PIPE tunary | PIPE tunary
tunary : tpost | TOP tunary
tpost : tprim | tpost DIMS | tpost [ type ]
tprim : qname | qname G< targs G> | STR | NUM | LIT | PM NUM | void | ( type ) | O{ tmembers } | O{ tmembers tsign } | [ ] | [ tuple ] | [ tuple , ] | typeof qname | NAME IS type
tuple : telem | tuple , telem
telem : type | NAME : type | DOTS type | type OPTIONAL
qname : NAME | qname . NAME
"""

GO = """
start : package NAME ; tops
tops : | tops top ; | tops ;
top : import_ | decl | func_
import_ : import spec | import ( specs )
specs : | spec | specs ; | specs ; spec
spec : STR | NAME STR | . STR
decl : const cspec | const ( cspecs ) | var vspec | var ( vspecs ) | type tspec | type ( tspecs )
cspecs : | cspec | cspecs ; | cspecs ; cspec
cspec : names | names = exprs | names typ = exprs
vspecs : | vspec | vspecs ; | vspecs ; vspec
vspec : names typ | names = exprs | names typ = exprs
tspecs : | tspec | tspecs ; | tspecs ; tspec
tspec : NAME typ | NAME = typ | NAME [ tparams ] typ
names : NAME | names , NAME
func_ : func NAME sig block | func NAME sig | func recv NAME sig block | func NAME [ tparams ] sig block | func recv NAME sig
tparams : tparam | tparams , tparam
tparam : NAME constraint | NAME
constraint : typ | constraint PIPE typ | TILDE typ
recv : ( NAME typ ) | ( typ )
sig : ( plist ) result
plist : | params | params ,
params : param | params , param
param : typ | NAME typ | DOTS typ | NAME DOTS typ
result : | typ | ( plist )
typ : tname | tname [ types ] | STAR typ | [ ] typ | [ expr ] typ | [ DOTS ] typ | map [ typ ] typ | chan typ | ARROW chan typ | chan ARROW typ | func sig | struct T{ fields } | interface T{ methods } | ( typ )
tname : NAME | NAME . NAME
types : typ | types , typ
fields : | field | fields ; | fields ; field
field : names typ | names typ STR | typ | typ STR
methods : | method | methods ; | methods ; method
method : NAME sig | constraint
block : { stmts }
stmts : stmt | stmts ; stmt
stmt : | simple | decl | block | return | return exprs | break | break NAME | continue | continue NAME | goto NAME | fallthrough | go expr | defer expr | if_ | for_ | switch_ | select { cases } | NAME : stmt
simple : exprs | exprs ASSIGN exprs | exprs = exprs | exprs DEFINE exprs | expr INC | expr ARROW expr | exprs DEFINE range expr | exprs = range expr
header : simple | ; | simple ; | ; simple | simple ; simple
if_ : if header block | if header block else block | if header block else if_
for_ : for block | for simple block | for range expr block | for osimple ; osimple ; osimple block
osimple : | simple
switch_ : switch { cases } | switch header { cases }
cases : | cases case exprs : stmts | cases default : stmts | cases case exprs DEFINE exprs : stmts | cases case expr ARROW expr : stmts
exprs : expr | exprs , expr
expr : unary | expr BIN expr | expr STAR expr | expr PM expr | expr PIPE expr | expr AMP expr
unary : prim | PM unary | STAR unary | AMP unary | BANG unary | ARROW unary | TILDE unary
prim : NAME | NUM | STR | ( expr ) | prim . NAME | prim . ( typ ) | prim . ( type_ ) | prim ( args ) | prim [ expr ] | prim [ expr , exprs ] | prim [ ospan : ospan ] | prim [ ospan : ospan : expr ] | prim L{ elems } | L{ elems } | func sig block | typed
type_ : typ
typed : [ ] typ | [ expr ] typ | [ DOTS ] typ | map [ typ ] typ | chan typ | struct T{ fields } | interface T{ methods }
ospan : | expr
args : | args_ | args_ , | args_ DOTS | args_ DOTS ,
args_ : expr | args_ , expr
elems : | elems_ | elems_ ,
elems_ : elem | elems_ , elem
elem : expr | expr : expr
"""

JAVA = """
start : units
units : | units unit
unit : package name ; | import name ; | import MOD name ; | import name . MUL ; | import MOD name . MUL ; | types_ | ;
types_ : mods tdecl
mods : | mods MOD
tdecl : class NAME tparams heritage cbody | interface NAME tparams heritage cbody | enum NAME heritage { enums members } | record NAME tparams ( params ) heritage cbody
heritage : | heritage extends types | heritage implements types | heritage permits types
types : type | types , type
tparams : | G< targs G>
targs : targ | targs , targ
targ : type | type extends bound | ? | ? extends type | ? super type
bound : type | bound AMP type
enums : | consts | consts , | consts ; | consts , ; | ;
consts : const | consts , const
const : NAME | NAME ( args ) | NAME cbody | NAME ( args ) cbody
cbody : { members }
members : | members member
member : ; | mods tdecl | mods block | mods type NAME ( params ) dims throws body | mods G< targs G> type NAME ( params ) dims throws body | mods name ( params ) throws body | mods G< targs G> name ( params ) throws body | mods type vars ; | mods name block
throws : | throws_ types
throws_ : throws
dims : | DIMS
body : block | ; | default expr ;
params : | params_
params_ : param | params_ , param
param : mods type NAME dims | mods type DOTS NAME | mods type this
vars : var_ | vars , var_
var_ : NAME dims | NAME dims = init
init : expr | array
array : { } | { inits } | { inits , } | { , }
inits : init | inits , init
type : base | type DIMS
base : PRIM | void | name | name G< targs G> | name G< G> | base . NAME | base . NAME G< targs G>
name : NAME | name . NAME
block : { stmts }
stmts : | stmts stmt
stmt : block | ; | expr ; | local ; | mods_ tdecl | tdecl | if_ | for_ | while ( expr ) stmt | do stmt while ( expr ) ; | return ; | return expr ; | throw expr ; | break ; | break NAME ; | continue ; | continue NAME ; | try_ | switch_ | NAME : stmt | synchronized ( expr ) block | assert expr ; | assert expr : expr ; | yield expr ;
local : type vars | mods_ type vars
mods_ : MOD | mods_ MOD
if_ : if ( expr ) stmt | if ( expr ) stmt else stmt
for_ : for ( for_init ; oexpr ; oexprs ) stmt | for ( local : expr ) stmt
for_init : | local | exprs
oexpr : | expr
oexprs : | exprs
exprs : expr | exprs , expr
try_ : try block catches | try ( resources ) block catches
resources : resource | resources ; resource | resources ;
resource : local | expr
catches : | catches catch ( ctypes NAME ) block | catches catch ( mods_ ctypes NAME ) block | catches finally block
ctypes : type | ctypes PIPE type
switch_ : switch ( expr ) { cases }
cases : | cases label stmts | cases arm
label : case exprs : | default :
arm : case exprs ARROW result | default ARROW result
result : expr ; | block | throw expr ;
expr : cond | unary ASSIGN expr | unary = expr | lambda | CAST lambda
lambda : NAME ARROW lbody | A( ) ARROW lbody | A( lparams ) ARROW lbody
lparams : lparam | lparams , lparam
lparam : NAME | type NAME | mods_ type NAME
lbody : expr | block
cond : bin | bin ? expr : expr | bin ? expr : lambda
bin : unary | bin BIN bin | bin PM bin | bin MUL bin | bin < bin | bin > bin | bin > > bin | bin > > > bin | bin AMP bin | bin PIPE bin | bin instanceof type | bin instanceof type NAME | bin instanceof mods_ type NAME
unary : post | PM unary | INC unary | BANG unary | CAST unary
post : prim | post INC
prim : name | NUM | STR | LIT | this | super | ( expr ) | prim . NAME | prim . G< targs G> NAME | prim . new creator | name ( args ) | prim ( args ) | name [ expr ] | prim [ expr ] | new creator | name . this | name . class | type_ . class | name REF NAME | prim REF NAME | name REF new | type_ REF new | switch_
type_ : PRIM | PRIM DIMS | name DIMS | name G< targs G> | void
creator : base ( args ) | base ( args ) cbody | base sizes | base DIMS array | base DIMS DIMS array
sizes : [ expr ] | sizes [ expr ] | sizes DIMS
args : | exprs
"""

PYTHON = """
start : stmts
stmts : | stmts stmt
stmt : simples NEWLINE | simples ; NEWLINE | compound | NEWLINE
simples : simple | simples ; simple
simple : tests | tests ASSIGN value | chain | tests : test | tests : test = value | pass | break | continue | return | return tests | raise | raise test | raise test from test | global names | nonlocal names | del exprs | assert test | assert test , test | import_ | yield_ | TYPE NAME tparams = test
value : tests | yield_
chain : tests = value | chain = value
yield_ : yield | yield tests | yield from test
names : NAME | names , NAME
import_ : import dotted_as | from source import MUL | from source import imported | from source import ( imported ) | from source import ( imported , )
source : dotted | dots dotted | dots
dots : . | DOTS | dots . | dots DOTS
dotted : NAME | dotted . NAME
dotted_as : as_name | dotted_as , as_name
as_name : dotted | dotted as NAME
imported : one | imported , one
one : NAME | NAME as NAME
compound : if_ | while_ | for_ | try_ | with_ | def_ | class_ | decorators def_ | decorators class_ | ASYNC def_ | ASYNC for_ | ASYNC with_ | decorators ASYNC def_ | match_
decorators : @ test_ NEWLINE | decorators @ test_ NEWLINE
suite : simples NEWLINE | simples ; NEWLINE | NEWLINE INDENT body DEDENT
body : stmt | body stmt
else_ : | else : suite
if_ : if test_ : suite elifs else_
elifs : | elifs elif test_ : suite
while_ : while test_ : suite else_
for_ : for exprs in tests : suite else_
try_ : try : suite finally : suite | try : suite excepts else_ | try : suite excepts else_ finally : suite
excepts : except_ | excepts except_
except_ : except : suite | except tests : suite | except test as NAME : suite | except MUL test : suite | except MUL test as NAME : suite
with_ : with tlist : suite | with items : suite
items : test as ex | tlist , test as ex | items , test as ex | items , telem
def_ : def NAME tparams ( params ) : suite | def NAME tparams ( params ) RARROW test : suite
tparams : | [ tplist ] | [ tplist , ]
tplist : tparam | tplist , tparam
tparam : param | MUL NAME = telem
params : | plist | plist ,
plist : param | plist , param
param : NAME | NAME : test | NAME = test | NAME : test = test | MUL | / | MUL NAME | MUL NAME : telem | POW NAME | POW NAME : test
class_ : class NAME tparams : suite | class NAME tparams ( args ) : suite
match_ : MATCH tests : NEWLINE INDENT cases DEDENT
cases : case_ | cases case_
case_ : CASE pattern : suite | CASE pattern if test_ : suite
pattern : pelems | pelems ,
pelems : pelem | pelems , pelem
pelem : ex | MUL ex | ex as NAME
tests : tlist | tlist ,
tlist : telem | tlist , telem
telem : test_ | MUL ex
test_ : test | NAME WALRUS test
test : or_ | or_ if or_ else test | lambda lparams : test
lparams : | lplist | lplist ,
lplist : lparam | lplist , lparam
lparam : NAME | NAME = test | MUL | / | MUL NAME | POW NAME
or_ : and_ | or_ or and_
and_ : not_ | and_ and not_
not_ : cmp | not not_
cmp : ex | cmp in ex | cmp not in ex | cmp is ex | cmp is not ex
ex : unary | ex BIN unary | ex PM unary | ex MUL unary | ex POW unary | ex / unary | ex @ unary
unary : prim | PM unary | TILDE unary | await unary
exprs : elist | elist ,
elist : selem | elist , selem
selem : ex | MUL ex
prim : NAME | NUM | strings | LIT | DOTS | ( ) | ( inner ) | [ ] | [ inner ] | { } | { entries } | prim . NAME | prim ( args ) | prim [ subs ]
strings : STR | strings STR
inner : tests | yield_ | telem comp | items | items ,
entries : tests | telem comp | pairs | pairs , | pair comp
pairs : pair | pairs , pair
pair : test : test | test : test as NAME | POW ex
comp : comp_for | comp comp_for | comp if or_ | comp if lambda lparams : or_
comp_for : for exprs in or_ | ASYNC for exprs in or_
args : | alist | alist ,
alist : arg | alist , arg
arg : test_ | NAME = test | NAME = test as NAME | MUL test | POW test | test_ comp | test as NAME
subs : slist | slist ,
slist : sub | slist , sub
sub : test_ | MUL ex | slice
slice : lead | lead test | lead step | lead test step
lead : : | test :
step : : | : test
"""

TEXTS = {"json": JSON, "javascript": _SCRIPT + _NO_TYPES, "typescript": _SCRIPT + _TYPES, "go": GO, "java": JAVA, "python": PYTHON}
END = "$"


class Table:
    """SLR(1) tables: action[state][token] is a state to shift to, or -1 - production; accept is the production of start."""

    def __init__(self, text: str) -> None:
        rules: list[tuple[str, tuple[str, ...]]] = []
        for line in text.strip().splitlines():
            left, _, right = line.partition(" :")
            for option in (" " + right.strip() + " ").split(" | "):
                rules.append((left.strip(), tuple(option.split())))
        self.rules = [("", (rules[0][0],)), *rules]
        by: dict[str, list[int]] = {}
        for n, (left, _) in enumerate(self.rules):
            by.setdefault(left, []).append(n)
        self.size = [len(r) for _, r in self.rules]
        self.left = [left for left, _ in self.rules]
        self._build(by)

    def _follow(self, by: dict[str, list[int]]) -> dict[str, set[str]]:
        empty, first = set(), {x: set() for x in by}
        changed = True
        while changed:
            changed = False
            for left, right in self.rules:
                got, all_empty = first[left], True
                before = len(got)
                for x in right:
                    got |= first[x] if x in by else {x}
                    if x not in empty:
                        all_empty = False
                        break
                if all_empty and left not in empty:
                    empty.add(left)
                    changed = True
                changed |= len(got) > before
        follow = {x: set() for x in by}
        follow[self.rules[0][1][0]].add(END)
        changed = True
        while changed:
            changed = False
            for left, right in self.rules:
                tail = follow[left]
                for x in reversed(right):
                    if x in by:
                        before = len(follow[x])
                        follow[x] |= tail
                        changed |= len(follow[x]) > before
                        tail = tail | first[x] if x in empty else first[x]
                    else:
                        tail = {x}
        return follow

    def _build(self, by: dict[str, list[int]]) -> None:
        follow = self._follow(by)

        def closure(kernel: frozenset[tuple[int, int]]) -> list[tuple[int, int]]:
            items, todo, seen = list(kernel), list(kernel), set(kernel)
            while todo:
                n, dot = todo.pop()
                right = self.rules[n][1]
                if dot < len(right):
                    for m in by.get(right[dot], ()):
                        if (m, 0) not in seen:
                            seen.add((m, 0))
                            items.append((m, 0))
                            todo.append((m, 0))
            return items

        start = frozenset([(0, 0)])
        states, todo = {start: 0}, [start]
        self.action: list[dict[str, int]] = []
        self.goto: list[dict[str, int]] = []
        at = 0
        while at < len(todo):
            items = closure(todo[at])
            at += 1
            moves: dict[str, set[tuple[int, int]]] = {}
            action: dict[str, int] = {}
            goto: dict[str, int] = {}
            for n, dot in items:
                right = self.rules[n][1]
                if dot < len(right):
                    moves.setdefault(right[dot], set()).add((n, dot + 1))
            for x, kernel in moves.items():
                key = frozenset(kernel)
                if key not in states:
                    states[key] = len(todo)
                    todo.append(key)
                (goto if x in by else action)[x] = states[key]
            for n, dot in sorted(items):
                if dot == len(self.rules[n][1]) and n:
                    for x in follow[self.left[n]]:
                        action.setdefault(x, -1 - n)
                elif n == 0 and dot == 1:
                    action[END] = -1
            self.action.append(action)
            self.goto.append(goto)
        ended = lambda n, dot: dot == len(self.rules[n][1]) and (dot > 1 or self.left[n] == "fbody")
        #: States after a ";" that ends a statement or member, being neither one of its own nor part of a for header.
        self.closed = {to for kernel, to in states.items() if any(ended(n, dot) and self.rules[n][1][-1] == ";" for n, dot in kernel)}


@lru_cache(maxsize=None)
def table(language: str) -> Table:
    return Table(TEXTS[language])
