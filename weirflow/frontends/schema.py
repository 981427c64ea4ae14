"""The nested row that lowering gives for each file.

Edges run backward, from a value to what it is made of. ``kind`` of an edge is
'flow', or 'through' from a call's result to its arguments (dropped where the
callee is known), or 'jump' for closures and globals.
"""

FUNCTION = "struct<fn:string,qual:string,line:int,params:array<string>,ret:string,enclosing:string,guards:array<string>,branches:int,instructions:int>"
NODE = "struct<node:string,fn:string,kind:string,path:string,line:int,block:int>"
EDGE = "struct<node:string,next:string,kind:string,site:string>"
CALL = "struct<call:string,fn:string,callee:string,resolved:string,result:string,line:int,block:int,idx:int,doms:array<int>,used_in_test:boolean,again:boolean>"
ARG = "struct<call:string,slot:int,name:string,node:string,literal:string,keys:array<string>>"
IMPORT = "struct<local:string,package:string,symbol:string>"
LOWERED = (
    "file string, lang string, family string, module string, error string, partial boolean, "
    f"functions array<{FUNCTION}>, nodes array<{NODE}>, edges array<{EDGE}>, calls array<{CALL}>, args array<{ARG}>, imports array<{IMPORT}>"
)
PARTS = ("functions", "nodes", "edges", "calls", "args", "imports")
