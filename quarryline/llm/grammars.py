"""Grammars of the languages that are judged, over tokens in which bracketed groups are single tokens.

What a group may be (arguments, a block, a class body ...) is judged from its own content with these same grammars,
so the terminal ``Args`` stands for a round bracket whose content is a list of arguments.
"""

# ---------------------------------------------------------------- JavaScript
_SCRIPT_EXPRESSIONS = """
Expr: Assign (',' Assign)*
Arg: ... Assign | Assign
Assign: Cond3 | Arrow | Target AssignOp Assign | Pattern = Assign | yield | yield '*'? Assign
AssignOp: = | BINASSIGN
Target: ID | PTarget | Postfix . NAME | Postfix . PRIVATE | Postfix Idx
Pattern: Obj | Arr
Cond3: Binary | Binary '?' Assign : Assign
Binary: Bits (LOGIC Bits)* | Bits (COALESCE Bits)+
Bits: Unary (BinOp Unary)* | PRIVATE in Unary
BinOp: BINOP | in | instanceof | '+' | - | '*' | < | '>' | '|' | & | '>' '>' | '>' '>' '>' | '>' >=
Unary: Update | Update POW Unary | PreOp Signed | await Unary
Signed: Update | PreOp Signed | await Signed
PreOp: '!' | ~ | '+' | - | typeof | void | delete
Update: Postfix | INC Target | Target INC
Postfix: Primary Suffix*
Suffix: . NAME | . PRIVATE | '?.' NAME | '?.' PRIVATE | '?.' Args | '?.' Idx | Args | Idx | TEMPLATE
Primary: ID | NUM | OCT | STR | TEMPLATE | REGEX | this | super | null | true | false | Cond | Arr | Obj | Function | Class | New | import Args | import . NAME | JSX
New: new Postfix | new . NAME
Function: async? function '*'? ID? Params Block
Arrow: async? ID => Body | async? Params => Body
Body: Block | Assign
Class: Decorator* class ID? Heritage? ClassBody
Heritage: extends Postfix
Decorator: @ Postfix ;?
Key: NAME | STR | NUM | OCT | Idx | PRIVATE
Mods: static | async | get | set | '*' | accessor
Member: Decorator* Mods* Key Params Block | Decorator* Mods* Key FieldInit? Eos | static Block | ;
FieldInit: = Assign
Members: Member*
Prop: Key : Assign | ID | ID = Assign | ... Assign | Mods* Key Params Block | Key : Assign = Assign
Param: Decorator* Binding | Decorator* Binding = Assign | ... Binding
Binding: ID | Obj | Arr
"""
_SCRIPT_STATEMENTS = """
Eos: ; | NL | $
Stmts: ( Stmt | With )*
Source: SCRIPT Stmts | MODULE Module
Module: ( Stmt | ModuleStmt )*
Stmt: Block | ; | Var Eos | !Brace !function !class Expr Eos | IfStmt | Loop | Jump | Try | ID : Stmt | switch Cond Cases | Function | Class | debugger Eos
Var: var Declarators | let Declarators | const Constant (',' Constant)*
VarKind: var | let | const
Declarators: Declarator (',' Declarator)*
Declarator: ID | Binding = Assign
Constant: Binding = Assign
IfStmt: if Cond Stmt | if Cond Stmt NL? else Stmt
Loop: while Cond Stmt | do Stmt NL? while Cond ;? | for await? ForHead Stmt
ForHeadIn: ForInit? ; Expr? ; Expr? | ForVar of Assign | ForVar in Expr
ForInit: Var | Expr
ForVar: VarKind Binding | Target | Pattern
Jump: return Expr? Eos | throw Expr Eos | break ID? Eos | continue ID? Eos
Try: try Block Catch | try Block Finally | try Block Catch Finally
Catch: catch CatchParam Block | catch Block
Finally: finally Block
CatchIn: Binding
CaseBody: CaseItem*
CaseItem: case Expr : Stmts | default : Stmts
ModuleStmt: import ImportWhat from STR Attributes? Eos | import STR Attributes? Eos | export ExportWhat
Attributes: with Obj
With: with Cond Stmt
ImportWhat: ID | Specs | '*' as ID | ID ',' Specs | ID ',' '*' as ID
ExportWhat: Specs ( from STR Attributes? )? Eos | '*' ( as Key )? from STR Attributes? Eos | default Default | Var Eos | Function | Class
Default: Function | Class | !function !class Assign Eos
Spec: NAME | NAME as NAME | STR as NAME | NAME as STR | STR
"""
_JSX = """
JsxElement: < > JsxChild* < / > | < JsxName JsxAttr* / > | < JsxName JsxAttr* > JsxChild* < / JsxName >
JsxName: NAME ( JsxJoin NAME )*
JsxJoin: . | - | :
JsxAttr: JsxAttrName | JsxAttrName = STR | JsxAttrName = JsxExpr | JsxAttrName = JSX | JsxSpread
JsxAttrName: NAME ( JsxJoin NAME )*
JsxChild: TEXT | JsxExpr | JSX
JsxInner: Expr? | ... Assign
"""
JAVASCRIPT = _SCRIPT_EXPRESSIONS + _SCRIPT_STATEMENTS + _JSX

# ---------------------------------------------------------------- TypeScript: what it adds
_TYPES = """
Bits: Bits as Type | Bits as const | Bits satisfies Type | Bits BinOp Unary
Target: Postfix '!'
Constant: Binding '!'? Ann | Binding '!'? Ann = Assign
Suffix: '!' | TypeArgs Args | TypeArgs TEMPLATE | '?.' TypeArgs Args
Primary: ID TypeArgs
PreOp: TypeArgs
Function: async? function '*'? ID? TypeParams? Params Ret? Block
Arrow: async? TypeParams? Params Ret? => Body
Ret: : RetType
RetType: Type | asserts ID ( is Type )? | ID is Type | this is Type
Class: Decorator* abstract? class ID? TypeParams? Heritage? Implements? ClassBody
Heritage: extends Postfix TypeArgs
Implements: implements Types
Types: Type (',' Type)*
Mods: public | private | protected | readonly | abstract | override | declare
Member: Decorator* Mods* Key '?'? TypeParams? Params Ret? Block | Decorator* Mods* Key '?'? TypeParams? Params Ret? Eos | Decorator* Mods* Key Opt? Ann? FieldInit? Eos | Mods* IdxSig Ann Eos
Opt: '?' | '!'
Ann: : Type
Prop: Mods* Key '?'? TypeParams? Params Ret? Block
Param: Decorator* Mods* Binding '?'? Ann? | Decorator* Mods* Binding '?'? Ann? = Assign | ... Binding Ann | this Ann
Declarator: Binding '!'? Ann | Binding '!'? Ann = Assign
ForVar: VarKind Binding Ann
CatchIn: Binding Ann
Stmt: TsDecl | declare TsDecl | declare Var Eos | declare Signature | declare Class | declare global NsBlock | Signature
Signature: async? function '*'? ID TypeParams? Params Ret? Eos
TsDecl: interface ID TypeParams? ( extends Types )? Iface | type ID TypeParams? = Type Eos | const? enum ID EnumBody | namespace QName NsBlock | module QName NsBlock | module STR NsBlock | abstract class ID TypeParams? Heritage? Implements? ClassBody
QName: ID ( . NAME )*
ModuleStmt: import type ImportWhat from STR Eos | import type? ID = require Args Eos | import type? ID = QName Eos | export = Expr Eos | export TsDecl | export declare TsDecl | export declare Var Eos | export declare Signature | export declare Class | export Signature | export type Specs ( from STR )? Eos | export type '*' from STR Eos | export as namespace ID Eos | export Decorator* abstract Class | export default TsDecl | export default Signature
Spec: type NAME | type NAME as NAME
EnumItem: Key | Key = Assign
Type: Union | Union extends Union '?' Type : Type | TypeParams? Params => RetType | abstract? new TypeParams? Params => Type
Union: '|' Union1 | & Union1 | Union1
Union1: TyUnary ( UnionOp TyUnary )*
UnionOp: '|' | &
TyUnary: TyPre* TyPostfix
TyPre: keyof | readonly | unique
TyPostfix: TyPrimary TySuffix*
TySuffix: ArrEmpty | TyIdx
TyPrimary: QName TypeArgs? | STR | NUM | - NUM | TEMPLATE | void | null | undefined | this | true | false | TyParen | TyTuple | Iface | typeof QName TypeArgs? | typeof import Args ( . NAME )* TypeArgs? | infer ID | import Args ( . NAME )* TypeArgs?
TypeArgs: < Types '>'
TypeParams: < TypeParam (',' TypeParam)* ','? '>'
TypeParam: Mods1* ID ( extends Type )? ( = Type )?
Mods1: const | in | out
TyItem: Type | ... Type | NAME '?'? : Type | ... NAME : Type | Type '?'
IfaceItem: Sign? readonly? Key '?'? Ann? | Key? '?'? TypeParams? Params Ret? | Acc Key Params Ret? | new TypeParams? Params Ret? | readonly? IdxSig Ann | Sign? readonly? IdxSig Ann | Sign? readonly? MapSig MapOpt? Ann
Acc: get | set
Sign: '+' | -
MapOpt: '?' | - '?' | '+' '?'
IdxSigIn: ID : Type
MapSigIn: ID in Type ( as Type )?
"""
TYPESCRIPT = _SCRIPT_EXPRESSIONS + _SCRIPT_STATEMENTS + _JSX + _TYPES

# ---------------------------------------------------------------- Python 3
PYTHON = """
Test: Or | Or if Or else Test | Lambda
Lambda: lambda LParams? : Test
LParams: LPlace ','? | LPlace ',' LStar ','? | LStar ','?
LPlace: LPlains | LPlains ',' LDefaults | LDefaults
LPlains: LPlain (',' LPlain)*
LPlain: NAME | /
LDefaults: LDefault (',' LDefault)*
LDefault: NAME = Test | /
LStar: '*' NAME (',' LNamed)* (',' LKeys)? | '*' (',' LNamed)+ (',' LKeys)? | LKeys
LNamed: NAME | NAME = Test
LKeys: '**' NAME
Or: Un ( Op Un )*
Op: OP | '*' | '|' | / | '**' | - | '+' | and | or | in | not in | is | is not
Un: PreOp* Post
PreOp: - | '+' | ~ | not | await
Post: Atom Trailer*
Trailer: . NAME | Args | Sub
Atom: NAME | NUM | STR+ | ... | None | True | False | Paren | List | Dict
Named: Test | NAME := Test
Star: Named | '*' Or
CompFor: async? for Targets in Or CompIf* | async? for Targets in Or if Or else Test
CompIf: if Or | if Lambda
Comp: Named CompFor+ | CompFor+
Targets: Target (',' Target)* ','?
Target: '*'? One
One: NAME | Post . NAME | Post Sub | TTuple | TList
Alone: NAME | Post . NAME | Post Sub | TOne
Arg: Star | NAME = Test | '**' Test | Named CompFor+
ParenOne: Named CompFor+ | Yield
Slice: Star | Test? : Test? | Test? : Test? : Test?
DictItem: Test : Test | '**' Or
DictOne: Test : Test CompFor+
Param: NAME | NAME : Test | NAME = Test | NAME : Test = Test | '*' | '*' NAME | '*' NAME : Star | '**' NAME | '**' NAME : Test | /
ImportName: NAME | NAME as NAME
WithItem: Test | Test as One
TypeParam: NAME ( : Test )? ( = Test )? | '*' NAME | '**' NAME
List1: Star (',' Star)* ','?
Yield: yield | yield List1 | yield from Test
Value: List1 | Yield
Simple: Small ( ; Small )* ;?
Small: Value | ( Targets = )+ Value | Alone AugOp Value | Alone : Test | Alone : Test = Value | del Deleted (',' Deleted)* ','? | pass | break | continue | return List1? | raise | raise Test | raise Test from Test | global Names | nonlocal Names | assert Test (',' Test)? | import Dotted (',' Dotted)* | FromImport | type NAME List? = Test
AugOp: AUG
Deleted: One
Names: NAME (',' NAME)*
Dotted: QName ( as NAME )?
QName: NAME ( . NAME )*
FromImport: from Dots QName? import What | from QName import What
Dots: ( . | ... )+
What: '*' | Imports | ImportName (',' ImportName)*
If: if Named :
Elif: elif Named :
Else: else :
TryHead: try :
Except: except : | except '*'? Test ( as NAME )? : | except Test (',' Test)+ :
Finally: finally :
While: while Named :
For: async? for Targets in List1 :
With: async? with WithItem (',' WithItem)* : | async? with WithItems :
Def: async? def NAME List? Params ( -> Test )? :
ClassHead: class NAME List? Args? :
Match: match List1 :
Case: case Pattern ( if Named )? :
Pattern: Star ( as NAME )? (',' Star ( as NAME )? )* ','?
Decorator: @ Named
If1: If Simple
Elif1: Elif Simple
Else1: Else Simple
Try1: TryHead Simple
Except1: Except Simple
Finally1: Finally Simple
Loop1: While Simple | For Simple
Head1: With Simple | Def Simple | ClassHead Simple | Case Simple
Suite: Statement+
Statement: L_Simple | L_Head1 | L_Decorator* L_Def B | L_Decorator* L_Class B | L_Decorator+ L_Head1 | IfPart ElifPart* ElsePart? | LoopPart ElsePart? | TryPart ExceptPart+ ElsePart? FinallyPart? | TryPart FinallyPart | L_With B | L_Match Cases
IfPart: L_If B | L_If1
ElifPart: L_Elif B | L_Elif1
ElsePart: L_Else B | L_Else1
LoopPart: L_While B | L_For B | L_Loop1
TryPart: L_Try B | L_Try1
ExceptPart: L_Except B | L_Except1
FinallyPart: L_Finally B | L_Finally1
CaseBody: ( L_Case B | L_Head1 )+
"""

# ---------------------------------------------------------------- JSON and TOML
JSON = """
Value: STR | NUM | true | false | null | Arr | Obj
Item: Value
Pair: STR : Value
"""
TOML = """
Value: STR | LONG | NUM | DATE | BOOL | Arr | Table
Key: KeyPart ( . KeyPart )*
KeyPart: BARE | STR
Pair: Key = Value
Header: '[' Key ']' | '[' '[' Key ']' ']'
Item: Value
"""
