"""Extraction from small files of each framework."""

import pytest

from codeloom.extract import interpret
from codeloom.extract.captures import captures

FILES = {
    "spring-boot": ("/p/src/UserController.java", """package a.b;
import a.c.UserService;
/** Talks. @see AuditLog @throws NotFound */
@RestController
@RequestMapping("/api/users")
public class UserController implements Api {
    @Autowired private UserService userService;
    private final OrderRepository orders;
    // @GetMapping("/no")
    @GetMapping("/{id}")
    public User get(@PathVariable Long id) { return userService.find(id); }
    @PostMapping
    public User create(@RequestBody User u) { return u; }
    @DeleteMapping(value = "/{id}")
    public void remove(@PathVariable Long id) { }
    @RequestMapping(path = "/all", method = RequestMethod.PUT)
    public void all() { }
}
@Entity
@Table(name = "users")
class User extends Base {
    private String name;
}
"""),
    "fastapi": ("/p/app/main.py", """from fastapi import APIRouter, Depends
import app.models
router = APIRouter(prefix="/items", tags=["x"])

class Item(BaseModel):
    name: str
    price: float = 0.0

@router.get("/{item_id}")
async def read(item_id: int, db: Session = Depends(get_db)):
    \"\"\"Reads. See :class:`ItemStore`.\"\"\"
    return 1

@router.post("")
def create(item: Item):
    return item
"""),
    "flask": ("/p/app.py", """bp = Blueprint("u", __name__, url_prefix="/old")
app.register_blueprint(bp, url_prefix="/users")

class User(db.Model):
    __tablename__ = "user_table"
    id = db.Column(db.Integer, primary_key=True)
    posts = relationship("Post")

@bp.route("/<int:id>", methods=["GET", "PUT"])
def one(id):
    return ""
"""),
    "django": ("/p/urls.py", """urlpatterns = [path("users/<int:id>/", views.user), path("x/", include("y.urls"))]
class Book(models.Model):
    title = models.CharField(max_length=9)
    author = models.ForeignKey("Author", on_delete=1)
"""),
    "express": ("/p/r.js", """const express = require('express');
import x from './svc/user';
router.get('/users/:id', auth.check);
router.post("/users", (req, res) => {});
app.use('/api', router);
cache.get('key');
class UserRepo extends Base { }
"""),
    "nestjs": ("/p/user.controller.ts", """import { A } from './a';
@Controller('users')
export class UserController {
  constructor(private readonly users: UserService, repo: UserRepo) {}
  @Get(':id')
  find(@Param('id') id: string) { return 1; }
  @Post()
  async create() { }
}
@Entity()
export class User {
  @PrimaryGeneratedColumn() id: number;
  @OneToMany(() => Post, p => p.user) posts: Post[];
}
"""),
    "gin": ("/p/main.go", """package main

import (
	"fmt"
	"github.com/gin-gonic/gin"
)

type User struct {
	ID   int    `gorm:"primaryKey"`
	Repo *UserRepo
}

func main() {
	r := gin.Default()
	v1 := r.Group("/v1")
	v1.GET("/users/:id", getUser)
	r.POST("/x", func(c *gin.Context) {})
}
"""),
    "rails": ("/p/routes.rb", """Rails.application.routes.draw do
  root 'home#index'
  get '/about', to: 'pages#about'
  resources :users
end
class User < ApplicationRecord
  has_many :posts
end
"""),
    "laravel": ("/p/api.php", """<?php
use App\\Models\\User;
Route::prefix('admin')->group(function () {
    Route::get('/users', [UserController::class, 'index']);
});
Route::apiResource('photos', PhotoController::class);
class User extends Model {
    protected $table = 'people';
    public function posts() { return $this->hasMany(Post::class); }
}
"""),
    "aspnet": ("/p/C.cs", """using System.Linq;
[ApiController]
[Route("api/[controller]")]
public class UserController : ControllerBase {
    public UserController(IUserService users) { }
    [HttpGet("{id}")]
    public User Get(int id) { return null; }
    [HttpPost]
    public User Create() { return null; }
}
"""),
    "actix": ("/p/main.rs", """use actix_web::web;
#[derive(Serialize, Deserialize)]
struct User { id: u32 }
#[get("/users/{id}")]
async fn get_user() -> X { }
fn c(cfg: &mut S) { cfg.route("/users", web::post().to(create_user)); }
"""),
    "tauri": ("/p/lib.rs", """#[tauri::command]
fn save_file(path: String) -> bool { true }
"""),
    "vapor": ("/p/routes.swift", """import Vapor
func routes(app: Application) {
    let users = app.grouped("api", "users")
    users.get(":id", use: c.show)
    app.post("login") { req in "x" }
}
"""),
    "ktor": ("/p/R.kt", """import io.ktor.server.routing.*
data class User(val id: Int) { }
fun Route.users() {
    route("/users") {
        get { call.respond(1) }
        get("/{id}") { call.respond(2) }
    }
}
"""),
    "angular": ("/p/app.ts", """const routes = [{ path: 'home', component: HomeComponent }];
@Component({ selector: 'app-x', template: '' })
export class XComponent { constructor(private http: HttpClient) {} }
"""),
    "react": ("/p/pages/UserPage.tsx", """import React, { useState } from 'react';
export const UserPage = ({ id, name = 'x' }) => {
  const [a, b] = useState(0);
  return fetch('/api/users');
};
"""),
    "vue": ("/p/UserList.vue", "<script setup>\nimport x from './x';\nconst r = useStore();\ndefineProps(['a', 'b'])\n</script>\n<template><p/></template>\n"),
    "sveltekit": ("/p/routes/shop/[id]/+page.svelte", "<script>\n  export let data;\n  import y from './y';\n</script>\n"),
}

ROUTES = {
    "spring-boot": {("DELETE", "/api/users/{id}", "UserController.remove"), ("GET", "/api/users/{id}", "UserController.get"), ("POST", "/api/users", "UserController.create"), ("PUT", "/api/users/all", "UserController.all")},
    "fastapi": {("GET", "/items/{item_id}", "read"), ("POST", "/items", "create")},
    "flask": {("GET", "/users/<int:id>", "one"), ("PUT", "/users/<int:id>", "one")},
    "django": {("ANY", "/users/<int:id>", "views.user")},
    "express": {("GET", "/users/:id", "auth.check"), ("POST", "/users", "<anonymous>")},
    "nestjs": {("GET", "/users/:id", "UserController.find"), ("POST", "/users", "UserController.create")},
    "gin": {("GET", "/v1/users/:id", "getUser"), ("POST", "/x", "<anonymous>")},
    "laravel": {("GET", "/admin/users", "UserController@index"), ("GET", "/photos", "photos#index"), ("POST", "/photos", "photos#create"), ("GET", "/photos/:id", "photos#show"), ("PUT", "/photos/:id", "photos#update"), ("DELETE", "/photos/:id", "photos#destroy")},
    "aspnet": {("GET", "/api/user/{id}", "UserController.Get"), ("POST", "/api/user", "UserController.Create")},
    "actix": {("GET", "/users/{id}", "get_user"), ("POST", "/users", "create_user")},
    "tauri": {("INVOKE", "/tauri/save_file", "save_file")},
    "vapor": {("GET", "/api/users/:id", "c.show"), ("POST", "/login", "<anonymous>")},
    "ktor": {("GET", "/users", "<anonymous>"), ("GET", "/users/{id}", "<anonymous>")},
    "angular": {("ANY", "/home", "HomeComponent")},
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(path, "p", framework, text) for framework, (path, text) in FILES.items()] + [("/p/none.txt", "p", None, "x"), ("/p/null.py", "p", "fastapi", None), (None, "p", "flask", "x"), ("/p/empty.py", "p", "flask", "")]
    return spark.createDataFrame(rows, "file_path string, project string, framework string, content string").cache()


@pytest.fixture(scope="module")
def caught(files):
    return captures(files).cache()


def by_framework(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r["framework"], set()).add(tuple(r[c] if not isinstance(r[c], list) else tuple(tuple(x) if not isinstance(x, str) else x for x in r[c]) for c in columns))
    return out


def test_routes(caught):
    got = by_framework(interpret.routes(caught), "method", "path", "handler")
    rails = got.pop("rails")
    assert {("GET", "/", "home#index"), ("GET", "/about", "pages#about"), ("GET", "/users/:user_id/edit", "users#edit")} <= rails and len(rails) == 9
    assert got == ROUTES


def test_convention_routes(files):
    got = {(r["file_path"], r["method"], r["path"]) for r in interpret.convention_routes(files).collect()}
    assert got == {("/p/pages/UserPage.tsx", "GET", "/UserPage"), ("/p/routes/shop/[id]/+page.svelte", "GET", "/shop/:id")}


def test_services(caught):
    got = {(r["framework"], r["name"]): (r["dependencies"], r["annotations"], r["implements"], r["extends"]) for r in interpret.services(caught).collect()}
    assert got["spring-boot", "UserController"] == (["OrderRepository", "UserService"], ["RestController", "RequestMapping"], ["Api"], [])
    assert got["nestjs", "UserController"][0] == ["UserRepo", "UserService"]
    assert got["aspnet", "UserController"][0] == ["IUserService"] and got["aspnet", "UserController"][3] == ["ControllerBase"]
    assert got["gin", "User"][0] == ["UserRepo"]
    assert got["angular", "XComponent"][0] == ["HttpClient"]
    assert got["actix", "User"][1] == ["derive", "Serialize", "Deserialize"] or {"Serialize", "Deserialize"} <= set(got["actix", "User"][1])


def test_entities(caught):
    got = {(r["framework"], r["name"]): (r["table_name"], [f["name"] for f in r["fields"]], [tuple(x) for x in r["relations"]]) for r in interpret.entities(caught).collect()}
    assert got["spring-boot", "User"] == ("users", ["name"], [])
    assert got["fastapi", "Item"] == ("item", ["name", "price"], [])
    assert got["flask", "User"] == ("user_table", ["id"], [("relationship", "Post")])
    assert got["django", "Book"] == ("book", ["title"], [("ForeignKey", "Author")])
    assert got["nestjs", "User"] == ("user", ["id"], [("OneToMany", "Post")])
    assert got["gin", "User"][:2] == ("user", ["ID", "Repo"])
    assert got["rails", "User"][2] == [("has_many", "posts")]
    assert got["laravel", "User"] == ("people", [], [("hasMany", "Post")])
    assert ("actix", "User") in got and ("spring-boot", "UserController") not in got


def test_components(caught, files):
    got = {(r["framework"], r["name"]): (r["props"], r["hooks"], r["is_page"]) for r in interpret.components(caught, files).collect()}
    assert got["react", "UserPage"] == (["id", "name"], ["useState"], True)
    assert got["vue", "UserList"] == (["a", "b"], ["useStore"], False)
    assert got["sveltekit", "+page"] == (["data"], [], True)
    assert ("angular", "XComponent") in got


def test_imports_and_references(caught, files):
    got = {(r["file_path"], r["import_path"]) for r in interpret.imports(caught).collect()}
    assert {("/p/src/UserController.java", "a.c.UserService"), ("/p/app/main.py", "fastapi"), ("/p/app/main.py", "app.models"), ("/p/r.js", "./svc/user"), ("/p/r.js", "express"), ("/p/main.go", "github.com/gin-gonic/gin"), ("/p/UserList.vue", "./x"), ("/p/routes.swift", "Vapor")} <= got
    refs = {(r["file_path"], r["name"]) for r in interpret.doc_references(files).collect()}
    assert refs == {("/p/src/UserController.java", "AuditLog"), ("/p/src/UserController.java", "NotFound"), ("/p/app/main.py", "ItemStore")}


def test_no_files(files):
    empty = captures(files.limit(0))
    assert empty.count() == 0 and interpret.routes(empty).count() == 0 and interpret.entities(empty).count() == 0
